"""Relational and vector operators over DataFrames."""
