"""A Spark-native engine for public-procurement notices."""
