"""Spark-native change-log replay, validation, run statistics and analytical queries."""
