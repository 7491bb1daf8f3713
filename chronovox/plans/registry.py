"""All queries over the reference operators, with their SQL."""

from __future__ import annotations

from chronovox.plans import queries_identity, queries_labels, queries_store, queries_timeline

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (queries_labels, queries_timeline, queries_identity, queries_store):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
