"""Operators for preparing training text: dedup, mixing, quality, privacy, chat, tokens and shards."""
