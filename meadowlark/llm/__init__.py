"""Operators for preparing training corpora, one module each; their queries are in :mod:`meadowlark.llm.queries`."""
