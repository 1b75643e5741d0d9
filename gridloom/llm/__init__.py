"""Training-data operators: language, quality, duplicates, mixing, tokens, search and output."""
