"""Operators for large-scale training-data preparation.

Nothing outside this package imports it.  ``queries`` holds the thin, registered
queries and ``sql`` their SQL counterparts.
"""
