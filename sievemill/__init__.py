"""Spark operators for keyed free-text records."""
