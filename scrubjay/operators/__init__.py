"""DataFrame operators: findings, provenance gate, scrubbing, reports."""
