"""Operators for large text corpora (tokens, filters, joins, archives, media).

Nothing outside this subpackage imports it.  Queries that apply the operators to
the provided tables are in ``pathloom.llm.queries``.
"""
