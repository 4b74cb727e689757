"""Column functions: plain Column-in, Column-out expressions, no Python UDFs."""
