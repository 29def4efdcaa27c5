"""Operators of a training-data pipeline; nothing outside this folder and
``corpus_pipeline.py`` imports it.  ``QUERIES`` and ``ORACLE`` are the named
queries that ``__spark_entry__.py`` adds when the folder is present."""
