"""Column-level helpers: every function returns a ``pyspark.sql.Column``."""
