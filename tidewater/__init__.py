"""Point-in-time market analytics as plain PySpark DataFrame transformations."""
