"""Column functions: keys, times, text and vectors."""
