"""Table sources: driver tables, the attempts binding and the route dimension."""

from routewise.sources.tables import read_table, TABLES
from routewise.sources.bindings import attempts_from_events, attempts_from_orders, read_attempts
from routewise.sources.routes import route_dim, eligibility_dim

__all__ = ["read_table", "TABLES", "attempts_from_events", "attempts_from_orders",
           "read_attempts", "route_dim", "eligibility_dim"]
