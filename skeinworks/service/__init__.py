"""Read-only access to the tables."""
