"""Operators for training-data pipelines and their queries; nothing else in the package imports this folder."""
