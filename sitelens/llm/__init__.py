"""Operators for training-data pipelines over the text tables.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
