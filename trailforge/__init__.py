"""Spark-native engine for ordered, stateful post-processing of GPS tracks."""
