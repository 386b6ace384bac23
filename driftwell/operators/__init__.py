"""Operators: sketches, estimators, reconciliation, chunking and deltas."""
