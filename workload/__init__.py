"""Driver workload: inputs derived from the given tables, the queries, and their SQL twins."""
