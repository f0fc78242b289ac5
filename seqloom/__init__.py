"""Spark-native analytics on ordered sequences."""
