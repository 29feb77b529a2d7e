"""Spark-native analytics over long, ordered document corpora."""
