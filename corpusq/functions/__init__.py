"""Part of corpusq."""
