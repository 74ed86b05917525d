"""Composite scores, evaluations and the registered query catalogue."""
