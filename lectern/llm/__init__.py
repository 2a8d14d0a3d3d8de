"""Operators of a training-data pipeline: decontamination, scoring, conversion, filtering, mixing, sharding, deduplication."""
