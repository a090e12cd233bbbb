"""Transit delay analytics as plain Spark ``DataFrame -> DataFrame`` operators."""
