"""Readers, published tables and scratch space."""
