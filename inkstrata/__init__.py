"""Spark-native analytics over structured document corpora."""
