"""Column operators: element-wise, per symbol over time, and per date across symbols."""
