"""Operators that prepare training text: cleaning, scoring, deduplication, mixing, packing, media."""
