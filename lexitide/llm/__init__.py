"""Training-data operators: scoring, filtering, deduplication, packing and search over document tables."""
