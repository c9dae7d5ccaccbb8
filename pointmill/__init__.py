"""Point-cloud analytics as Spark DataFrame operators."""
