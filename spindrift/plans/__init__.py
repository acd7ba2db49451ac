"""Whole plans: hybrid search, context assembly, the engine."""
