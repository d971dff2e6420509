"""Plan helpers: written intermediate tables, global ranks, strategy choice."""
