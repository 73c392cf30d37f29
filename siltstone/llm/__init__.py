"""Operators that clean and check text for training corpora; nothing outside this package imports it."""
