"""Column functions: money in integer paise."""
