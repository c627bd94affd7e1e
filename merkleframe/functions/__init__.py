"""Functions of the snapshot engine."""
