"""Spark-native analytics for emergency-management data."""
