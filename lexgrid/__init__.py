"""Lexical document retrieval on Spark: analysis, weighted inverted indexes, ranked search and its evaluation."""
