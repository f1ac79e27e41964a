"""Operators for preparing language-model training corpora.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""
