"""Operators of a training-data pipeline: deduplication, quality, decontamination, tokens, licences, sharding."""
