"""Readers and the bridge from order tables to listings."""
