"""Column builders: timestamps, predicates and text."""
