"""Training-data operators: deduplication, language and quality models, search, tokens, packing, secrets.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
