"""Consolidated market-listing analytics and corpus preparation on PySpark."""
