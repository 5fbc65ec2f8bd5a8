"""Inputs: delimited files, Parquet folders, and generated rows."""
