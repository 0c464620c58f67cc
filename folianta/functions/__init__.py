"""Column functions and query-text analysis."""
