"""Operators for preparing training text: filters, fingerprints, dedup, mixing and tokenising."""
