"""shelfmark: a Spark-native index of skill-description files found in code repositories."""

__version__ = "0.1.0"
