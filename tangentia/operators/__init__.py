"""Operators over tables of manifold-valued rows."""
