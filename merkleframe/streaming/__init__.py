"""Streaming extensions of the snapshot engine."""
