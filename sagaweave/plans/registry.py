"""All core queries and their SQL, by name."""

from __future__ import annotations

from . import core_problems, episode_queries

_MODULES = [core_problems, episode_queries]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "p2_found"
