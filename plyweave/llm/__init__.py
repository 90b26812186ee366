"""Operators for preparing training data: sharding, near-duplicates, scoring, encoding, packing.

Nothing outside this subpackage imports it.  Each module holds one operator with its general
interface; :mod:`plyweave.llm.queries` holds the thin ``opN_*`` queries over the test tables.
"""
