"""Spark-native analytics over 1-based closed intervals."""
