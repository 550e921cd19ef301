"""Training-data operators: deduplication, language, quality, mixing, sharding, archives and tokens."""
