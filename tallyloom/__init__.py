"""Spark-native retrieval evaluation and representation-drift analytics."""

__version__ = "0.1.0"
