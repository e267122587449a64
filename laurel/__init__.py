"""Spark-native analytics for large collections of competition-style results."""
