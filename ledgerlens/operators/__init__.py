"""Graph operators: gate, upserts, patterns, checks, triples, keys, analytics."""
