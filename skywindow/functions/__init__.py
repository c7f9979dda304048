"""Column functions: hygiene, geography, sun, signal."""
