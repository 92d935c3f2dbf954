"""Graphs of operators declared as JSON."""
