"""Spark-native analytics over an append-only log of immutable deltas."""
