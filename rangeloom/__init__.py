"""Skew-resilient sorting and range partitioning on Spark."""
