"""A text search and catalog engine on PySpark."""
