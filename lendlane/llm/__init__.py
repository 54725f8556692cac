"""Operators for preparing training data: language, quality, near-duplicates, tokens, mixing, packing."""
