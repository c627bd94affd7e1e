"""Workflows of the snapshot engine."""
