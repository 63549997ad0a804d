"""Training-data operators: counting, filtering, de-duplicating, redacting, encoding and packing a corpus.

Nothing else in the library imports this subpackage.
"""
