"""A Spark-native engine for key-value structures, documents, logs and search."""
