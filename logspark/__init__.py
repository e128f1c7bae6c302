"""Log and incident analytics as Spark DataFrame operators."""
