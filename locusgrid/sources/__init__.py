"""Readers: text formats to DataFrames."""
