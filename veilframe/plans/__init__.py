"""DataFrame transforms built from the column expressions."""
