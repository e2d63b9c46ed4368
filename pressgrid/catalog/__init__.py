"""Registered queries."""
from __future__ import annotations

import importlib

MODULES = ["tables", "texts", "search", "trust", "recommend", "replay", "ingest", "streams"]


def load():
    from .registry import ORACLES, QUERIES
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
