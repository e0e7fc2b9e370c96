"""Training-data operators: quality, tokens, near-duplicates, secrets, language models."""
