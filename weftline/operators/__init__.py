"""Row operators: transforms, merges, lookups by similarity."""
