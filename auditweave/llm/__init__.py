"""Training-data operators: search, near-duplicates, filters, tokenisation and packing.

Nothing else in the library imports this subpackage.  ``registry`` lists its queries.
"""
