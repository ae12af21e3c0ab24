"""Spark-native attribution of changes in soil-moisture drought."""
