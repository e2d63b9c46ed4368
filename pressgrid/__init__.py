"""Spark-native news trust, search and recommendation analytics."""
