"""stratalite: geoscience analytics and training-data operators on PySpark."""
