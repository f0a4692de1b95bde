"""Data profiling, quality rules and repair as Spark DataFrame transformations."""
