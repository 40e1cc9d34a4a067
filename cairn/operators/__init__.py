"""Relational, spatial and iterative operators."""
