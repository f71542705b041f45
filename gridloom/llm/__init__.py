"""Operators of a training-data pipeline: extraction, filters, deduplication, joins, coding and packing.

Nothing outside this package imports it.
"""
