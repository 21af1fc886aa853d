"""Column expressions: native Spark only, no Python UDFs."""
