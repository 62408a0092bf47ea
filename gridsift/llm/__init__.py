"""Training-data operators: near-duplicates, filters, models, tokens, mixing.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
