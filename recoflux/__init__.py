"""A Spark-native engine for recommendation analytics."""
