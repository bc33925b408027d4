"""Column expressions: text rules, paths, provenance."""
