"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it.  Every operator takes a
DataFrame (usually ``documents``) and returns one; the thin ``opN_*``
queries in :mod:`pennyweight.llm.queries` derive digest columns from
the operators' real outputs.
"""
