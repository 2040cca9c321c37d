"""Column functions: tile mathematics, geometry, tile encoding, text."""
