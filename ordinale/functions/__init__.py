"""Column functions with exact rules for 64-bit wraparound, IEEE numbers and nulls."""
