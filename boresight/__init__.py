"""Evidence and risk analytics as composable PySpark DataFrame operators."""
