"""Column expressions: value text, digests and paths, geometry headers."""
