"""Spark-native engine for a ledger of marketplace listings."""
