"""Training-data operators for very large text corpora.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
queries and their SQL; each operator lives in a module of its own.
"""
