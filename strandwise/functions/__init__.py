"""Column functions, all built from Catalyst expressions."""
