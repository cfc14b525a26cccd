"""taleflow: Spark-native analytics for transcribed-speech corpora."""

__version__ = "0.1.0"
