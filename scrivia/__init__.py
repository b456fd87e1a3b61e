"""Spark-native analytics over long text reports."""
