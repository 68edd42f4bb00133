"""Spreadsheet-style analytics on Spark: a formula language, table tools and sources, planned by Catalyst."""

__version__ = "0.1.0"
