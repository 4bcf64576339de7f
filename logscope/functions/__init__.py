"""Column expressions. No function here registers a UDF."""
