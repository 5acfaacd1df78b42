"""functions of the report engine."""
