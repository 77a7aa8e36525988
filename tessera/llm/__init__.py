"""Operators for preparing training corpora.

Nothing outside this package imports it; :mod:`tessera.llm.registry` lists its
queries and their SQL for the entry module.
"""
