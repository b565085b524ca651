"""tollgate: a Spark-native engine for evaluating transaction monitoring under a daily review budget."""

__version__ = "0.1.0"
