"""Training-data operators: secrets, near-duplicates, personal data, BPE, web captures, quality, packing,
language identification, repeated passages and vector search.  Nothing else in the library imports this package."""
