"""Spark-native analytics over collections of nested report records."""
