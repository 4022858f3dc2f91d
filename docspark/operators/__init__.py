"""Operators on the engine's DataFrames."""
