"""Corpus operators for training-data pipelines.

Nothing outside this folder imports it, apart from the guarded import in
``__spark_entry__.py``.
"""
