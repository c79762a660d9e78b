"""Spark-native prediction trust: measure, judge and reject a classifier's predictions."""

__version__ = "0.1.0"
