"""Column expressions: distances, grid cells, predicates, array helpers."""
