"""Spark-native analytics over OCR text, page structure and text corpora."""
