"""Corpus operators for language-model training data."""
