"""Operators on DataFrames: matching, resolution, ranking, provenance."""
