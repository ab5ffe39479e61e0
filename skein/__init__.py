"""A Spark-native engine for incremental document monitoring."""
