"""Spark-native analytics for media-processing operations data."""
