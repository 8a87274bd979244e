"""Operators for training-data pipelines: media, mixing, near-dedup, chat, secrets, shards, tokens, toxicity."""
