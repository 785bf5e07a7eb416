"""Operators of a training-data pipeline: tokenising, duplicate detection,
secrets, language, packing, personal data, vector search and quality.

Nothing else in the library imports this subpackage.
"""
