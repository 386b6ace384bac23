"""Whole reconciliations, and the queries that exercise every operator."""
