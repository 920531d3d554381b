"""Operators for training-data corpora: sharding, deduplication, scoring, mixing, packing and token output."""
