"""Operators for training data and record linkage; nothing else in cairn imports this package."""
