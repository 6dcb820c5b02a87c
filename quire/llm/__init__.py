"""Corpus preparation for language-model training; nothing else in quire imports it."""
