"""Operators for training-data preparation, self-contained beside the grouped analytics."""
