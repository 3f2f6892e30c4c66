"""A PySpark-native analytics engine for scholarly document collections."""
