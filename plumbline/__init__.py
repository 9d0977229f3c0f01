"""A PySpark-native engine that maps where a computation can be trusted."""
