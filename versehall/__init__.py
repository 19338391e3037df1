"""Text, dialogue and evaluation analytics as composable PySpark DataFrame operators."""
