"""Listing analytics and data preparation on PySpark."""
