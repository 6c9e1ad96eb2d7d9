"""All queries of the engine proper, by name, with their SQL."""

from . import archive, ingest, search, sessions, store

_MODULES = (search, store, sessions, ingest, archive)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
