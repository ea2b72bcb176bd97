"""Spark-native analytics over media bitstreams, blocks, frames and documents."""
