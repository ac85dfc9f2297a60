"""Operators for preparing language-model training data.

Nothing outside this package imports it, apart from the guarded import in ``__spark_entry__.py``
and ``corpus_pipeline.py``.
"""
