"""Training-data operators: packing, joins, deduplication, formatting, filters, token work.

Nothing outside this subpackage imports it.
"""
