"""Sports-prediction and betting analytics as PySpark DataFrame operators."""
