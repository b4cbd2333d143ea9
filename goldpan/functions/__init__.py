"""Column functions that stay inside Spark's own expressions."""
