"""Operators of a training-data pipeline: filters, deduplication, token counts, mixing."""
