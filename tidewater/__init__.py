"""A PySpark-native analytics and text-data engine."""
