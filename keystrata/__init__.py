"""Content-addressed analytics on PySpark."""
