"""Spark-native analytics for windowed multi-channel signals."""
