"""All registered queries of the library and their oracles, by name."""

from __future__ import annotations

from memlake.plans import docs, facts, forms, graph, ledger, scans, search, store, streams, upkeep

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (store, graph, docs, search, ledger, upkeep, streams, scans, facts, forms):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
