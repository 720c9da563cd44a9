"""Training-data operators: filtering, deduplication, mixing and packaging of text corpora."""
