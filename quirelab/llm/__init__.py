"""Operators for training-data pipelines. Nothing else in quirelab imports this subpackage."""
