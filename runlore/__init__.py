"""runlore: Spark-native analytics over command and event logs."""

__version__ = "0.1.0"
