"""A PySpark-native analytics engine for dependency and usage data."""
