"""Operators for training-data pipelines: dedup, scans, scores, mixing and packing of document tables."""
