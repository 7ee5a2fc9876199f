"""Spark-native social analytics: every operator is a function from DataFrames to a DataFrame."""
