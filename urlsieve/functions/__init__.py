"""Column functions: every one maps Columns to Columns, with no Python UDF."""
