"""Spark-native analytics over traces, profiles, cluster timings, configuration dumps and logs."""

__version__ = "0.1.0"
