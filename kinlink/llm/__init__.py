"""Corpus preparation operators: scans, filters, deduplication, packing and extraction."""
