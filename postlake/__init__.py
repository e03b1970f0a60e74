"""Postlake: a PySpark-native engine for collecting, normalising and querying postings."""
