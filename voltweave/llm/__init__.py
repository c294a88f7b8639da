"""Operators that prepare training data: scoring, screening, joining and mixing of text corpora."""
