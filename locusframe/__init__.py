"""Spark-first analytics for genomic and general tabular data."""
