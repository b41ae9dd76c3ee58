"""Operators for training text: cleaning, scoring, tokenising, fingerprints, packing."""
