"""Training-data operators: scoring, deduplication, mixing, formatting, packing."""
