"""Schedule compliance and log analytics as Spark DataFrame operators."""
