"""Operators for preparing large text corpora, with their queries and SQL.

Nothing outside this subpackage (but ``corpus_pipeline.py``) imports it.
"""
