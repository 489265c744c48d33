"""Spark-native retrieval, evaluation and corpus analytics."""
