"""A Spark-native engine that turns fetched web pages into business leads."""

__version__ = "0.1.0"
