"""Column factories: every function takes and returns Spark Columns."""
