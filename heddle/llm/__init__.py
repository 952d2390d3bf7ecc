"""Operators of a training-data pipeline: quality, mixing, PII, deduplication, language, packing, extraction, URLs, tokens."""
