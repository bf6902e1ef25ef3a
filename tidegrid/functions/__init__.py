"""Column functions on vectors and names."""
