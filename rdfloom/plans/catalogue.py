"""All core queries by name and the SQL of those that SQL can express."""

from __future__ import annotations

from rdfloom.plans import measures, packed, structure

_MODULES = (structure, measures, packed)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
