"""Marts and reports: functions from input DataFrames to a result DataFrame."""
