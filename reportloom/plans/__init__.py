"""plans of the report engine."""
