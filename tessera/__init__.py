"""Spark-native retrieval and analytics over collections of long business documents."""
