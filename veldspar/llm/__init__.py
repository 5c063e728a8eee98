"""Operators for preparing training text: packing, decontamination, classifiers, joins, searches and deduplication."""
