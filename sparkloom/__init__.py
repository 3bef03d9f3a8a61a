"""A PySpark engine for versioned documents: discover, chunk, identify, embed, upsert."""
