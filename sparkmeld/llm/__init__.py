"""Training-data operators: deduplication, filtering, classification and mixing of document corpora."""
