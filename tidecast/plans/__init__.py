"""Named queries (Spark), their DuckDB oracle SQL, and the reports."""
