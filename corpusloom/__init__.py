"""Spark-native analytics for dated, attributed text corpora."""
