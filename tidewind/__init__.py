"""Point-in-time time-series analytics and training-data operators on PySpark."""
