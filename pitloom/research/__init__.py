"""Experiments, reports and the command line."""
