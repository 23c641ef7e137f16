"""Training-data operators: quality, dedup, mixing, packing, archives, indexes, fingerprints."""
