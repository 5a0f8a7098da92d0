"""Operators for building training data for language models, and their queries."""
