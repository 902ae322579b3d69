"""Training-data operators: scoring, sharding, mixing, scans, dedup, packing,
fingerprints, extraction, exact search and language identification.

Nothing else in the package imports this subpackage.
"""
