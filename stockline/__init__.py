"""Retail sales and inventory analytics as PySpark DataFrame operators."""
