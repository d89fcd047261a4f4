"""Training-data operators: quality, toxicity, tokens, secrets, copies, PII, mixing, vector search.

Nothing outside this subpackage imports it.
"""
