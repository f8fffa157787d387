"""The corpus queries and their SQL."""

from __future__ import annotations

from . import corpus_queries as Q
from . import stages


def queries():
    found = {name: f for name, f in vars(Q).items() if name.startswith("op") and callable(f)}
    return found | {"pipeline": stages.run}


def oracle_sql():
    return dict(Q.SQL) | ({"pipeline": stages.ORACLE_SQL} if stages.ORACLE_SQL else {})
