"""Table extraction scoring on Spark: payloads to HTML, canonical form, grids, alignment and tree scores, run reports."""
