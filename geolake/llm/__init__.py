"""Operators for preparing training data: fingerprints, near-duplicates, search, scoring, mixing, encoding, extraction."""
