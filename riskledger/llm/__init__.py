"""Operators for large text corpora: extraction, deduplication, filtering, packing and archives.

Nothing else in the library imports this subpackage; ``registry`` holds its queries.
"""
