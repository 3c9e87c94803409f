"""Millrace: automated tabular analytics and training-data preparation on PySpark."""
