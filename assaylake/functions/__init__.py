"""Column functions: text keys, numbers, units, JSON and identity."""
