"""lexmill: a Spark-native engine for text retrieval, answer grading,
training-set construction and run telemetry."""

__version__ = "0.1.0"
