"""Scalar functions of the graph model."""
