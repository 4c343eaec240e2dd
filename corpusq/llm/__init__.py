"""Operators for preparing language-model training data. Nothing else in corpusq imports this package."""
