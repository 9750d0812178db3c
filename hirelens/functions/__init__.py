"""Column functions: numbers, text, periods and label rules."""
