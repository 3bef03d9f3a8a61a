"""Column functions; native expressions but for hashes that Spark lacks."""
