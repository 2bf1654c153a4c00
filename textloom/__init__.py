"""Spark-native reconstruction and analytics of noisy text documents."""
