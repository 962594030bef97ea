"""Operators for training-data pipelines: scoring, scanning, mixing, deduplication,
decontamination, extraction, sharding and counting of text documents.

Nothing else in the library imports this package.
"""
