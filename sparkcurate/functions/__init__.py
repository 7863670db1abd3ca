"""Column builders: pure expressions over built-in Spark functions, no I/O and no Python UDF."""
