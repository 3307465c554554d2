"""Incremental forms of the batch stages."""
