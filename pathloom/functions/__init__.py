"""Functions for columns with JSON texts, paths and values."""
