"""Operators for preparing training text: scoring, extraction, joins, packing and search."""
