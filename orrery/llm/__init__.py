"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it (``corpus_pipeline.py`` and the guard in
``__spark_entry__.py`` apart), so it can be removed as a whole.
"""
