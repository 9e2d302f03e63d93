"""strandline: Spark-native analysis of the structure of compiled applications."""

__version__ = "0.1.0"
