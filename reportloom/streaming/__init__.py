"""streaming of the report engine."""
