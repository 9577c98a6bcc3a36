"""Training-data operators: packing, quality, near-duplicates, extraction, leakage, privacy and language models."""
