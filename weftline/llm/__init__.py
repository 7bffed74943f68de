"""Training-data operators: archives, filters, deduplication, search, mixing, packing."""
