"""Plan-level helpers and the query catalog wired into __spark_entry__."""
