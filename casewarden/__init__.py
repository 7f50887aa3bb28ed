"""Spark-native financial-crime case analytics."""
