"""Spark jobs for building, splitting, matching and scoring labelled tables of string-encoded objects."""

__version__ = "0.1.0"
