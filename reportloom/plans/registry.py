"""Registration of queries with the SQL that they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reportloom.plans.bindings import CTES, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_ctes(names: str, sql: str, more: str = "") -> str:
    """``sql`` under the named views and those that they read, and under further, possibly recursive ones."""
    wanted: list[str] = []

    def add(name: str) -> None:
        if name not in wanted:
            for other in CTES:
                if other != name and re.search(rf"\b(FROM|JOIN) {other}\b", CTES[name]):
                    add(other)
            wanted.append(name)

    for name in names.split():
        add(name)
    views = [CTES[n] for n in wanted] + ([more] if more else [])
    return ("WITH RECURSIVE " if more else "WITH ") + ", ".join(views) + " " + sql if views else sql


def query(name: str, ctes: str = "", sql: str | None = None, more: str = ""):
    """Registers f(views) under ``name``; ``ctes`` are the report views that ``sql`` reads, ``more`` its own."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_ctes(ctes, sql, more)
        return f

    return register
