"""Composed query plans and the registry the driver reads."""

from __future__ import annotations

import importlib

_MODULES = ("q_features", "q_summary", "q_evaluate", "q_incidents", "q_models", "q_streaming", "flagship")


def load_all():
    from vigil.plans.registry import ORACLE, QUERIES
    for m in _MODULES:
        try:
            importlib.import_module(f"vigil.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"vigil.plans.{m}":
                raise
    return QUERIES, ORACLE
