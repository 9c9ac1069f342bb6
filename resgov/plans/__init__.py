"""Plans: the registered governance queries (Spark side and DuckDB oracle SQL)
and plan-shape checks."""
