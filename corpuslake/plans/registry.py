"""Names of the registered queries: {name: (spark, sf_dir) -> DataFrame} and their DuckDB twins."""

from corpuslake.plans import conversations, details, files, indexes, keyed, lifecycle, repeats, reports, search, streams, tasks, turn_state
from corpuslake.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "conversations", "details", "files", "indexes", "keyed", "lifecycle", "repeats", "reports", "search", "streams", "tasks", "turn_state"]
