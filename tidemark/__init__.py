"""Spark-native changepoint analytics over many event streams."""
