"""The operation log and the sorted runs, on any file system Spark reads."""
