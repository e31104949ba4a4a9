"""Readers: manifests, audio files, prepared tables, prompts."""
