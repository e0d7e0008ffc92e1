"""Operators for large training-data pipelines.

Nothing outside this folder (but for the guarded import in ``__spark_entry__``
and ``corpus_pipeline.py``) imports it.
"""
