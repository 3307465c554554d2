"""Relational operators of the pipeline: DataFrame in, DataFrame out."""
