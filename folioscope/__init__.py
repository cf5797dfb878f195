"""Comparing versions of structured documents with Spark: scan, match, classify, pair amounts, report."""
