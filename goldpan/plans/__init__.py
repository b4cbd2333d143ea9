"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ["scoring", "reports", "checks", "batches", "texts", "catalogs", "retrieval", "audits", "files"]


def load():
    """Import every plan module; returns (queries, checking SQL)."""
    from . import registry

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLES
