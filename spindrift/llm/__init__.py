"""Operators of a training-data pipeline, each built from DataFrames and bounded tasks."""
