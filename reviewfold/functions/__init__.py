"""Column functions: they build expressions and never touch a DataFrame."""
