"""Case-management analytics as Spark DataFrame operators."""
