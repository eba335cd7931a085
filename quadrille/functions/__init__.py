"""Column expressions: geometry, grid cells, tree addresses, text forms. No Python UDFs."""
