"""Spark-native analytics for annotated sequence records, with operators for large text corpora."""
