"""Operators for large text corpora. Nothing else in plumbline imports this subpackage."""
