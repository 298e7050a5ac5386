"""Ordered key-value analytics on PySpark."""
