"""tessera: Spark-native preparation and measurement of language-model training data."""

__version__ = "0.1.0"
