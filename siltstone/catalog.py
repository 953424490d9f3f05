"""Registry of the engine's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from siltstone.plans import corpus, retrieve, scalars, stages

_PARTS = (scalars, retrieve, corpus, stages)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
