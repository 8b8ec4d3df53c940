"""Column functions: text and names, values and dates."""
