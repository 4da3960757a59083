"""Plan shapes shared by the operators: written intermediates, skew-safe joins, ranks and top-k."""
