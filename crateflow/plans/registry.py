"""Query registry: key -> (Spark builder, oracle SQL or None).

Builders receive a table handle (``Model``) for the dataset directory.
Oracle SQL uses plain binding names; ``oracle_sql()`` prefixes the binding
texts as CTEs so DuckDB runs it on the driver's parquet views.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from crateflow.sources.bindings import BINDINGS, Model, binding_order, sql_text


@dataclass
class Entry:
    key: str
    build: Callable[[Model], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, sql)
        return fn
    return deco


_NAME_RE = {n: re.compile(rf"\b{n}\b") for n in BINDINGS}


def with_bindings(sql: str) -> str:
    """Prefix the binding CTEs that ``sql`` uses."""
    used = [n for n, rx in _NAME_RE.items() if rx.search(sql)]
    ctes = [f"{b} AS ({sql_text(b)})" for b in binding_order(used)]
    body = sql.strip()
    recursive = False
    m = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if m:
        recursive = bool(m.group(1))
        body_ctes, body = body[m.end():], None
        head = "WITH RECURSIVE " if recursive else "WITH "
        return head + ",\n".join(ctes + [body_ctes]) if ctes else head + body_ctes
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _load_all() -> None:
    # importing the plan modules fills REGISTRY
    from crateflow.plans import catalog_plans, derive_plans, graph_plans, load_plans  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def bind(e: Entry):
        return lambda spark, sf_dir: e.build(Model(spark, sf_dir))

    return {k: bind(e) for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: with_bindings(e.sql) for k, e in REGISTRY.items() if e.sql}
