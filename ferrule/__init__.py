"""ferrule: a Spark-native retrieval, ranking and corpus-processing engine."""

__version__ = "0.1.0"
