"""Tessella: a PySpark-native analytics engine."""
