"""A PySpark-native table, interval and validation library."""
