"""Summation over streams."""
