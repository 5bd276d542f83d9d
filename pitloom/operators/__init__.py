"""Joins, windows and cross-section steps that Spark has no single operator for."""
