"""Operators for preparing training text: search, filters, fingerprints, dedup, mixing and packing."""
