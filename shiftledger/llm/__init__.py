"""Operators that prepare training data: cleaning, deduplication, scoring, mixing, packing, formatting and search."""
