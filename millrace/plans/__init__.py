"""Composed jobs and reports."""
