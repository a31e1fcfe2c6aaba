"""Spark-native operators for governing machine-learning data and models."""
