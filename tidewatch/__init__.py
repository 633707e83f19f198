"""Spark-native on-chain risk analytics."""
