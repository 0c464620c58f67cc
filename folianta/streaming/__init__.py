"""Append-only logs and reservations."""
