"""Labeling reviews as they arrive."""
