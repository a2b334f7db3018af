"""Graphs of source files that arrive over time."""
