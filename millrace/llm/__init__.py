"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` has the thin ``opN_*`` queries
that derive the contract's digest columns from it.
"""
