"""Operators for training data: coding, filters, deduplication, formatting, extraction and scoring of texts."""
