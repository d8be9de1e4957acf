"""Column functions and vectorized feature helpers."""
