"""Column functions: predicates, scalars, named functions and geometry."""
