"""Column -> Column building blocks. Built-in Spark expressions only."""
