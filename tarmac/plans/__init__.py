"""Whole stages composed from operators: ingest, backfill, training and scoring."""
