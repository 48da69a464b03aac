"""Readers of delimited text, and result handles."""
