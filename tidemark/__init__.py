"""Spark-native retail behaviour analytics."""
