"""Column-level building blocks: expressions in, expressions out."""
