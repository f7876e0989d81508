"""Operators of a training-data pipeline: scoring, extraction, deduplication, tokenisation, archives."""
