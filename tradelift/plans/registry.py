"""Query and oracle registration, and the shared SQL views oracles are built from."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict = {}
_VIEWS: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a `(spark, sf_dir) -> DataFrame` and, if given, its oracle's final SELECT."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def view(name: str, body: str) -> None:
    """Define a CTE that any oracle (or later view) may name."""
    _VIEWS[name] = body.strip()


def _used(body: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_][a-z0-9_]*\b", body))
    return [v for v in _VIEWS if v in words]


def oracle_text(final: str) -> str:
    order: list[str] = []

    def visit(v):
        if v in order:
            return
        for d in _used(_VIEWS[v]):
            if d != v:
                visit(d)
        order.append(v)

    for v in _used(final):
        visit(v)
    if not order:
        return final.strip()
    ctes = ",\n".join(f"{v} AS (\n{_VIEWS[v]}\n)" for v in order)
    final = final.strip()
    if final.upper().startswith("WITH "):
        return f"WITH RECURSIVE {ctes},\n{final[5:]}"
    return f"WITH RECURSIVE {ctes}\n{final}"
