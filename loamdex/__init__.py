"""A Spark-native engine for knowledge retrieval, graph, memory and evaluation analytics."""
