"""Column functions: text, markup and cells."""
