"""Column functions: text, JSON, numbers."""
