"""Training-data operators: dedup, language, fingerprints, secrets, tokens, mixing, sharding, archives.

Nothing else in the library imports this subpackage.
"""
