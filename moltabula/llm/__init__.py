"""Operators for training-data pipelines: one module for each, and the queries that apply them to the tables."""
