"""Column-level helpers: sort keys, literal-safe search, canonical strings."""
