"""Statistics and ordered computations."""
