"""Operators of a training-data pipeline: near-duplicates, repeats, scoring, mixing, packing, extraction."""
