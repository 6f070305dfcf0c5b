"""Training-data operators on Spark: packing, extraction, quality, tokens, duplicates, PII.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. ``QUERIES`` and
``ORACLE`` are what ``__spark_entry__.py`` registers.
"""

from feedlens.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
