"""Operators of a training-data pipeline: dedup, filters, scoring, mixing and token output."""
