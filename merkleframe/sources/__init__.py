"""Sources and sinks of the snapshot engine."""
