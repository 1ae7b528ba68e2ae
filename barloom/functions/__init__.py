"""Column functions: labels, numbers, categories, formats."""
