"""Spark-native text-corpus preparation, retrieval and retrieval evaluation."""
