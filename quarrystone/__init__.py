"""Spark-native analytics over large document collections."""
