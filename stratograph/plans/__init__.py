"""Named queries with their SQL statements."""
