"""Named queries of the library, each with its SQL for an independent engine where SQL can say it."""

from __future__ import annotations

from . import cleaning, features, learning, modelling, spaces

_MODULES = (cleaning, features, learning, spaces, modelling)
QUERIES: dict = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL: dict = {name: q for m in _MODULES for name, q in m.SQL.items()}
