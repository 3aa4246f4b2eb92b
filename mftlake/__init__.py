"""File-system-image analytics on PySpark."""
