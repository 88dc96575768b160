"""Brindle: Spark-native interaction analytics and training-data operators."""
