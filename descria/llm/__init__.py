"""Operators for preparing training text: quality, duplicates, contamination, packing, files, archives."""
