"""Spark-native analytics for scored conversations, written on the DataFrame API."""
