"""Operators of a training-data pipeline: fingerprints, shards, packing, search, tokens, quality, language models, duplicates, toxicity."""
