"""Customer-feedback analytics as Spark DataFrame transformations."""
