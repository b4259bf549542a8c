"""Training-data operators: deduplication, tokenisation, filtering, packing."""
