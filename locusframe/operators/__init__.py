"""Relational, interval and variant operators over DataFrames."""
