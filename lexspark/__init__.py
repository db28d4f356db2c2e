"""A Spark-native ranked full-text search engine."""
