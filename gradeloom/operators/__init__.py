"""Relational operators of corpus curation and evaluation."""
