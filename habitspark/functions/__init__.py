"""Column expressions: geography, terrain, text."""
