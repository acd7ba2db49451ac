"""Corpus analytics, retrieval and evaluation on PySpark."""
