"""Spark-native feature, enrichment and evaluation operators for located, labelled assets."""
