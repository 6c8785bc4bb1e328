"""Spark-native analytics over text, facts, prices, snapshots and events."""
