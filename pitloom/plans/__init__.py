"""Table builders: each a lazy DataFrame plan."""
