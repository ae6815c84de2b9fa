"""Training-data operators: mixing, tokenizing, archives, dedup, extraction and quality rules."""
