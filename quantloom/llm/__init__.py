"""Training-data operators: archives, language ID, deduplication, scoring, mixing, sharding, filtering."""
