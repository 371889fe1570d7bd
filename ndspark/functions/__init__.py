"""Column builders: elementwise arithmetic, mathematics and aggregates with the array library's semantics."""
