"""Operators of a training-data pipeline: language, quality, duplicates, tokens, mixing, search and chat formats."""
