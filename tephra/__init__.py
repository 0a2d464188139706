"""Spark-native analytics over hazards, evidence text and training corpora."""
