"""The registry of core queries and of the SQL they are held against."""

from framelake.plans import audit, further, media, ordered, storage

_MODULES = (media, audit, ordered, further, storage)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
