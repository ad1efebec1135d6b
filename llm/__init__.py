"""Operators for training-data pipelines: one module per operator, queries in ``llm.queries``.

Nothing outside this folder, ``corpus_pipeline.py`` and ``__spark_entry__.py`` imports it.
"""
