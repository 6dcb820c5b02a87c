"""Readers of recorded engine output, word lists and page files."""
