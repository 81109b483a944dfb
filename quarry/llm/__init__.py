"""Training-data operators: deduplication, filtering, formatting, tokenizing and packing of text tables.

Nothing outside this subpackage imports it. Every module holds one operator with its own general interface and the
thin ``opN_*`` query that applies it to a whole table; ``entries`` lists those queries.
"""
