"""Temporal fact analytics and conjunctive pattern queries on PySpark."""
