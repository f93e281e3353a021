"""DataFrame operators: payload converters, scoring, run records."""
