"""Spark-native engine for comparing gridded elevation data."""
