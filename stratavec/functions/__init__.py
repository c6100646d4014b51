"""Column builders over packed vectors and seeded hash functions."""
