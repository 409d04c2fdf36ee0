"""Property-market analytics as Spark DataFrame transformations."""
