"""Operators for preparing language-model training corpora.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""
