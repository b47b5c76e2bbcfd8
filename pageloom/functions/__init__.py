"""Column functions: strings, URLs, CSS declarations, numbers and dates."""
