"""Operators on DataFrames of trajectories."""
