"""Readers and generated tables."""
