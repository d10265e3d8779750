"""Operators of a training-data pipeline: tokenisation, model scoring, filtering, near-duplicate
removal, packing, licence scans and vector search.

The subpackage stands alone: nothing else in ``millrace`` imports it.  Every operator takes a
DataFrame with its own column parameters and returns a DataFrame; ``queries`` holds the thin
``opN_`` queries on the test tables.
"""
