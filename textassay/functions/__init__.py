"""Column functions: text, patterns, repair and small numeric rules."""
