"""Spark-native redaction, restoration and span scoring for document packs."""
