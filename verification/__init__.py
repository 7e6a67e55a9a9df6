"""DuckDB statements that compute the catalog's results independently of Spark."""
