"""Operators for building training corpora: deduplication, quality, counts,
personal data, url filters, packing, mixing and licence scans.

Nothing else in the library imports this subpackage.
"""
