"""Column functions on vectors."""
