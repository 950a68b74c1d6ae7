"""Operators of a training-data pipeline (mixing, scoring, deduplication,
packing, archives, quality).  Nothing else in the library imports this
subpackage; its queries are registered by ``queries.py``."""
