"""Whole pipelines: reports in, tables and serving documents out."""
