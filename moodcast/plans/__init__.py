"""Composed jobs: the batch analysis, the query registry and its SQL oracle."""
