"""Operators for large training-data corpora.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface and the thin ``opN_`` query over the given tables.
"""
