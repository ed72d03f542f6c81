"""Merges, keys and joins."""
