"""Operators for large training corpora, their queries and the corpus pipeline's stages.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
