"""Column functions: text cleaning, natural order, cells."""
