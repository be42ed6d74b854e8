"""Operators for training-data pipelines: secrets, near copies, fingerprints, quality, packing, personal data, archives,
exact search, tokenisation and toxicity. Nothing outside this subpackage imports it."""
