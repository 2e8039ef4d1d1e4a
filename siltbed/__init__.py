"""A Spark-first engine for versioned key-value data."""
