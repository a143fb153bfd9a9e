"""Spark-native analytics for streams of published news documents."""
