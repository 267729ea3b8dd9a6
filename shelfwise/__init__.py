"""Shelfwise: a PySpark-native analytics engine for large catalogues of items."""
