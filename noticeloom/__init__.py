"""Spark-native document-to-listing analytics: extraction, matching, dedup and reports."""
