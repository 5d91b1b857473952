"""Operators for training-data pipelines: filtering, deduplication, tokens, packing, sharding."""
