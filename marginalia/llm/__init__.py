"""Training-data operators: sharding, language id, quality, mixing, search, packing, dedup, counting, secrets."""
