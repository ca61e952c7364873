"""Training-data operators: sharding, media, tokenizers, PII, dedup, packing, fingerprints, toxicity.

Nothing outside this subpackage imports it.
"""
