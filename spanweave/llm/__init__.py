"""Operators for texts of language-model corpora. Nothing outside this package imports it."""
