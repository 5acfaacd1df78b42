"""operators of the report engine."""
