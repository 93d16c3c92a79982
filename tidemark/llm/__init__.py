"""Operators for large text corpora: filters, joins, searches, mixing and packing, each a DataFrame function."""
