"""Column expressions and pure functions: text, HTML, grids, alignment, trees."""
