"""Spark-native analytics and risk scoring for publicly funded works."""
