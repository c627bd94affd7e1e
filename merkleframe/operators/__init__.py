"""Relational operators of the snapshot engine."""
