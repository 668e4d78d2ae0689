"""Training-data operators: sharding, filtering, de-duplication, search, tokenising, packing."""
