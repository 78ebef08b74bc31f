"""Reading and writing panel tables."""
