"""Column functions: text rules, dates, numbers and p-values."""
