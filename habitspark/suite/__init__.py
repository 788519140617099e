"""Registered queries with their SQL counterparts over the given tables."""

from __future__ import annotations

import importlib

MODULES = ["cleaning", "metrics", "raster", "spatial", "modelling", "models"]


def load():
    """Import every query module and return (queries, sql)."""
    from habitspark.suite import registry

    for name in MODULES:
        importlib.import_module(f"habitspark.suite.{name}")
    return registry.QUERIES, registry.SQL
