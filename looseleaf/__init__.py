"""Spark-native operators for document corpora, knowledge graphs and consultation data."""
