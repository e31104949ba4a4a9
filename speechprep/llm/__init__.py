"""Preparation of text for training language models: ten operators, their queries and SQL."""
