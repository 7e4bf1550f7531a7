"""Reports composed from the operators, and the binding to a star schema."""
