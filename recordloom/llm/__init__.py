"""Operators for preparing text corpora at scale. Nothing else in recordloom imports this subpackage."""
