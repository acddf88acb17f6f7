"""SQL expressions of text and rule functions, for Spark and for plain SQL."""
