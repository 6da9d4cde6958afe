"""Operators for preparing large text corpora.

One module per operator; ``queries`` holds the thin registered queries.  Nothing outside this
subpackage imports it.
"""
