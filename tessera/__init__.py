"""Spark-native record matching: normalisation, candidate retrieval, features, decisions."""
