"""All registered queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from . import queries as _q  # noqa: F401  (registers X, P, V queries)
from . import queries_build as _qb  # noqa: F401  (registers S, D, T, E, C, I queries)

QUERIES = _q.QUERIES
ORACLE = _q.ORACLE
