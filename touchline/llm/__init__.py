"""Operators of a training-data pipeline (deduplication, token counts,
language identification, packing, mixing, fingerprints, token files).

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
