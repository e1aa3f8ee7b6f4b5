"""DataFrame operators, grouped by area."""
