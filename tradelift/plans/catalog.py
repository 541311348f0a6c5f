"""All registered queries and oracles."""

from __future__ import annotations

from importlib import import_module

from tradelift.plans import registry

MODULES = ["rfm", "scope", "discount", "models", "returns", "explore", "annual", "scenario", "streams"]


def _load():
    for m in MODULES:
        import_module(f"tradelift.plans.{m}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return {k: registry.oracle_text(v) for k, v in registry.ORACLES.items()}
