"""Training-data operators: dedup, filtering, search, packing, archives, tokenizing.

Self-contained: nothing else in ``tessera`` imports this subpackage.
"""
