"""Spark-native retrieval, evaluation and corpus-preparation operators."""
