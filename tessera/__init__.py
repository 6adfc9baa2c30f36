"""Spark-native feature-vocabulary, similarity-retrieval and evaluation engine."""
