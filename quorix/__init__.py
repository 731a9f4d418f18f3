"""quorix: Spark-native Bayesian and consensus learning, with the data processing around it."""

__version__ = "0.1.0"
