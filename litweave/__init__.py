"""Spark-native analytics for research-literature corpora."""
