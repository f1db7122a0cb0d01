"""Spark-native scoring of free-text answers and auditing of rankings."""
