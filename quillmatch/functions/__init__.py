"""Column functions: text normalisation and hashing."""
