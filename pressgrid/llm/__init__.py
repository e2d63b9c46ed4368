"""Operators for training corpora; nothing else in the library imports this subpackage."""
from __future__ import annotations

import importlib

MODULES = ["lm_scoring", "secret_scan", "rlz_dedup", "pii_anchors", "decontamination", "line_frequency", "compression_bands", "packing", "simhash",
           "language_mixture", "spelling_variants", "toxicity", "merkle_manifest"]


def load():
    """(queries, SQL) of the operators' modules."""
    found = [importlib.import_module(f"{__name__}.{m}") for m in MODULES]
    return {k: f for m in found for k, f in m.QUERIES.items()}, {k: s for m in found for k, s in m.ORACLES.items()}
