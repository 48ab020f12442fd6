"""Column functions: cleaning, scoring, metadata, metrics."""
