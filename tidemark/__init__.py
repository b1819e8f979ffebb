"""Spark-native bar, signal and order-ledger analytics."""
