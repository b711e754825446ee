"""Column-level building blocks: text predicates, rounding rules and filters."""
