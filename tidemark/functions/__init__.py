"""Column expressions: time buckets, ordered aggregates, numbers, geography, vectors."""
