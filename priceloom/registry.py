"""Collects the registered queries and their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ("series", "setops", "offers", "compare", "events", "querylog", "streams", "content", "views", "resolution", "shortlist", "files")


def _load():
    for name in MODULES:
        importlib.import_module(f"priceloom.queries.{name}")
    return importlib.import_module("priceloom.queries.base")


def queries() -> dict:
    return dict(_load().QUERIES)


def oracles() -> dict:
    """A CTE list may stand without its WITH, so that lists can be joined."""
    return {k: v if v.lstrip().upper().startswith(("WITH", "SELECT")) else f"WITH {v}" for k, v in _load().ORACLES.items()}
