"""Content-addressed snapshot analytics on DataFrames."""
