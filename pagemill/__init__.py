"""Spark-native analytics over stored web pages."""
