"""Operators that prepare training data: filtering, tokenizing, search, dedup, formatting, packing."""
