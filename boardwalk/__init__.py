"""Boardwalk: projection boards and draft-value analytics on PySpark DataFrames."""
