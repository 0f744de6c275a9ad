"""Column functions and expressions."""
