"""All queries of the engine over the synthetic tables, each with its DuckDB SQL where SQL can say it."""

from . import features, stored, tables  # noqa: F401

QUERIES = features.QUERIES | tables.QUERIES
ORACLE_SQL = features.ORACLE_SQL | tables.ORACLE_SQL

#: Searches over whole grids: they come last where queries are run one after the other.
LONGEST = ("m03_lr_scores", "m04_gbt_scores")
