"""Column functions: labels, names, units, dtypes, geometry predicates."""
