"""Spark-native table diff, sync and replication, with a corpus-preparation subpackage."""

__version__ = "0.1.0"
