"""Operators for large text corpora: cleaning, duplicate search, tokens, language."""
