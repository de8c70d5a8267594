"""Operators for training-data pipelines over document and vector tables."""
