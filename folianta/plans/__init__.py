"""Queries over the library model, each with its SQL."""
