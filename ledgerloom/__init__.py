"""Spark-native analytics over append-only activity ledgers."""
