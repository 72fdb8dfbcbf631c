"""Spark-native analytics for event listings."""
