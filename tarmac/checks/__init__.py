"""Registered queries over the driver tables and their equivalent SQL."""
