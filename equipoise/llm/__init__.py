"""Operators for preparing training text: dedup, mixing, packing, tokens, quality, extraction."""
