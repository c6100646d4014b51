"""Spark-native analytics over dense vectors."""
