"""Queries of each group of products, with the SQL that checks them."""
