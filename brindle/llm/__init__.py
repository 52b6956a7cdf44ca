"""Operators that prepare training text: deduplication, language, mixing, packing, retrieval, extraction."""
