"""Spark-native engine for analytic two-dimensional periodic geometry."""

__version__ = "0.1.0"
