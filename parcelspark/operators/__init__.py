"""Joins and windows that products are built from."""
