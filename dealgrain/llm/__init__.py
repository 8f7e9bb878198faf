"""Operators of a training-data pipeline: deduplication, filtering, scanning, scoring, archives and packing."""
