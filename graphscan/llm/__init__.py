"""Operators for preparing language-model training data.

Nothing outside this folder (but for the guarded import in ``__spark_entry__``
and the top-level ``corpus_pipeline``) imports it.
"""
