"""Operators of a training-data pipeline: packing, tokenizing, search, scans, fingerprints, models, archives."""
