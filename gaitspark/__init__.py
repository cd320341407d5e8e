"""Spark-native analytics for multi-sensor single-task / dual-task mobility trials."""

__version__ = "0.2.0"
