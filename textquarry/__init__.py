"""Spark-native text, retrieval and knowledge-graph analytics."""
