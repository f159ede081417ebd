"""Operators for preparing training data for language models.

Each module holds one operator with a general interface; ``queries`` registers
them.  Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
