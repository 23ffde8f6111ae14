"""Operators for building training data: formatting, extraction, packing, archives, tokens, cleaning, duplicates, language."""
