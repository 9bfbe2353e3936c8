"""Column builders: recodes, classification predicates, formatting."""
