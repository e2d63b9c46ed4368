"""Two dictionaries that the query modules fill: name -> DataFrame function, name -> SQL."""
from __future__ import annotations

from .oracle_views import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: (SQL, views) of a query, for others that must give the same rows in another way.
SAME: dict[str, tuple] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, with its SQL where SQL can say it."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, extra)
            SAME[name] = (sql, extra)
        return fn
    return keep
