"""PySpark-native analytics over multi-rate episode recordings."""
