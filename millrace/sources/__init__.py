"""Readers of landed entities."""
