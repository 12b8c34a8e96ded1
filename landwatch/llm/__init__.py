"""Operators for large text corpora: filtering, near duplicates, privacy, mixing, packing, tokens."""
