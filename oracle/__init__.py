"""Independent SQL statements of the queries, for checking results."""
