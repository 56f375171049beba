"""pointspark: point-cloud analytics as PySpark DataFrame operators."""
