"""Spark-native relational analytics: operators, SQL front end, key-value access and statistics."""

__version__ = "0.1.0"
