"""The registered queries of the timed-text part, each with SQL that another engine runs on the same tables."""

from __future__ import annotations

from tidemark.plans import catalog, chat, corruption, markers, scalars, timeline, topics

MODULES = (scalars, timeline, chat, topics, corruption, markers, catalog)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
