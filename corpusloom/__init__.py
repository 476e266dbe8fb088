"""Spark-native analysis of factorially designed text corpora and their embeddings."""
