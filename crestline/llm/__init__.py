"""Operators that prepare text corpora for training: scans, filters, de-duplication, encoding and packing."""
