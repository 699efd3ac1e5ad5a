"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from turnwise.plans.ctes import CTES

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _needed(sql: str, found: list[str]) -> None:
    for name in CTES:
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(CTES[name], found)
            if name not in found:
                found.append(name)


def with_ctes(sql: str) -> str:
    names: list[str] = []
    _needed(sql, names)
    if not names:
        return sql
    # The steps of the beam are used by several later ones each.
    once = {n for n in names if n.startswith(("z_d", "z_succ", "z_nodes", "z_tree", "z_prefix", "z_num"))}
    shared = "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in once else ''}({CTES[n]})" for n in names)
    own = sql.lstrip()
    return f"{shared},\n{own[5:]}" if own.startswith("WITH ") else f"{shared}\n{own}"


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_ctes(sql)
        return fn

    return register
