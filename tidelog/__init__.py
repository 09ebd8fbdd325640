"""Spark-native analytics over partitioned, append-only logs."""
