"""All queries of the statement operators and their SQL."""

from __future__ import annotations

from tallyloom.plans import bridging, composing, detailing, feeds, filed, flowing, histories, lining, mending, merges, queries, scalars, selecting, series

PARTS = (queries, scalars, merges, mending, selecting, bridging, detailing, series, feeds, filed, histories, flowing, lining, composing)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
