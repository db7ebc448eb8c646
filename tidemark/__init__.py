"""Time-series analytics, lifecycle management and similarity search on PySpark."""
