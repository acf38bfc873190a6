"""Full-text search: query parsing, matching, ranking, highlights, vectors (OP-X)."""
