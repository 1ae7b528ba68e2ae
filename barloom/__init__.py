"""barloom: end-of-day market analytics expressed as PySpark DataFrame operators."""
