"""Operators for text corpora at training scale; nothing else in the library imports this package."""
