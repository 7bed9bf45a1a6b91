"""A PySpark-native analytics engine for literature knowledge graphs."""
