"""Whole reports: one scan and parse, a handful of small aggregations, text and JSON."""
