"""evgraph: a PySpark-native engine for repository evidence graphs."""
