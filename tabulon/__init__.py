"""Tabulon: a PySpark-native engine for cleaning and querying semi-structured institutional content."""
