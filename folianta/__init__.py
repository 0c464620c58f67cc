"""folianta: a PySpark-native analytics engine for libraries of documents."""

__version__ = "0.1.0"
