"""Grouped, joined and windowed operators on DataFrames."""
