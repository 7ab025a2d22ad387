"""DataFrame-level operators, one module per family."""
