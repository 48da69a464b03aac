"""Relational and semiring algebra over collections."""
