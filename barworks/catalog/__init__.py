"""Every operator as a named query over the given tables."""

from __future__ import annotations

import importlib

MODULES = ("bar_queries", "signal_queries", "trade_queries", "review_queries", "stream_queries")


def load():
    """(queries, checks) of all catalog modules."""
    from barworks.catalog import registry

    for name in MODULES:
        importlib.import_module(f"barworks.catalog.{name}")
    return registry.QUERIES, registry.ORACLES
