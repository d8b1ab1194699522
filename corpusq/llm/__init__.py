"""Operators for training-data pipelines at corpus scale."""
