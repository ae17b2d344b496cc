"""Operators for building language-model training data.

Nothing else in the package imports this subpackage; the queries over it are
in ``daybook.llm.queries`` and the pipeline in ``corpus_pipeline.py``.
"""
