"""Column functions: text rules, clocks, levels."""
