"""Training-data operators: text filters, near-duplicate search, tokenizers.

Nothing else in the library imports this subpackage.
"""
