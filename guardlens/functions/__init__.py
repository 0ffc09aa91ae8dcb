"""Column builders and scale-safe ordered / quantile primitives."""
