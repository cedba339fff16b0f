"""Spark-native basket and add-on recommendation analytics."""
