"""Training-data operators: tokens, packing, dedup, fingerprints, media, PII and classifiers."""
