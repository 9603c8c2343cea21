"""Operators for large training corpora: tokenising, language ID, deduplication, quality, search, mixing, scans, sharding."""
