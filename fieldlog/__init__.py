"""Ordered-event analytics on PySpark."""
