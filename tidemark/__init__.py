"""A PySpark-native analytics engine."""
