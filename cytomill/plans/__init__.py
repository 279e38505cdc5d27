"""Runnable queries over the driver tables, grouped by family."""

from __future__ import annotations

import importlib

from cytomill.plans import registry

FAMILIES = ["profiling", "regions", "transcriptomics", "imaging", "clustering", "volumes", "scores", "scalars", "inout", "streams"]


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"cytomill.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
