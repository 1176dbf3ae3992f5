"""The queries over the driver's tables and their SQL twins, gathered from the query modules."""

from __future__ import annotations

from tidemark.queries import flows, ledger, market, strategy, studies

_MODULES = (market, ledger, strategy, flows, studies)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
