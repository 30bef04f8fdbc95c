"""Trajectory operators: DataFrame in, DataFrame out."""
