"""Training-data operators (near-dedup, filters, scans, scoring, packing).

Nothing else in the library imports this subpackage; its registered queries
are in ``hirelake.llm.queries``.
"""
