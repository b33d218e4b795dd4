"""Operators over DataFrames of lines, parsed lines and their aggregates."""
