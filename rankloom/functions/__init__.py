"""Column functions; each is a Spark expression."""
