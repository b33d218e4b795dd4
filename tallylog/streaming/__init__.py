"""Structured Streaming over lines of logs."""
