"""Operators for training-data pipelines.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
``opN_*`` queries and their SQL; every other module holds one operator with
its general interface.
"""
