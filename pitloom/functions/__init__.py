"""Column expressions that every table builder shares."""
