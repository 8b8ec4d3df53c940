"""Training-data operators: packing, scoring, filtering, near-duplicates, storage and mixing."""
