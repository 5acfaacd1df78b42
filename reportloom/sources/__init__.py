"""sources of the report engine."""
