"""Spark-native data work for multi-view captures."""
