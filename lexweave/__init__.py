"""A Spark-native engine for corpus terminology analysis."""
