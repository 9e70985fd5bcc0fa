"""Corpus operators for training-data pipelines.

Nothing outside this folder (and the top-level ``corpus_pipeline.py``) imports it.
"""
