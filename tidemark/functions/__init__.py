"""Column expressions: row-local scalars and fixed-reach rolling indicators."""
