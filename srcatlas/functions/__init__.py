"""Column functions: spans, positions, names, completion keys, cfg predicates."""
