"""Spark-native analytics over live aircraft position snapshots."""
