"""Query text to syntax tree to DataFrame plan."""
