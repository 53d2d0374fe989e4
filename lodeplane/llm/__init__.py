"""Operators for training text and source corpora; nothing outside this package imports it."""
