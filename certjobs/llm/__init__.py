"""Corpus preparation for language-model training: deduplication, filtering, scanning, extraction and packing."""
