"""Spark-native analysis of free-text safety reports, and the dataset engineering around it."""
