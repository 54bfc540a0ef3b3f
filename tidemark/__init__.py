"""Market time-series analytics and corpus operators on PySpark."""
