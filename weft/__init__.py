"""A Spark-native engine for link analytics on undirected graphs."""
