"""Operators of a training-data pipeline: encoding, language, quality, duplicates, leaks and private data."""
