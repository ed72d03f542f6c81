"""Operators for preparing language-model training text at scale.

Nothing outside this folder imports it; the registered queries and their SQL are in :mod:`millrace.llm.queries`.
"""
