"""Spark-native analytics for place- and time-structured tables."""
