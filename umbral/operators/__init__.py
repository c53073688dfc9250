"""Relational, quality, privacy and tracing operators over DataFrames."""
