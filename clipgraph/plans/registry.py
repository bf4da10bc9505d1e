"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipgraph.plans import views

QUERIES: dict[str, Callable[[views.Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` and, where one exists, its SQL check."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](views.Views(spark, sf_dir))


def duck_sql(name: str) -> str:
    """The check as one statement: the views it needs come first as CTEs."""
    body = ORACLES[name].strip()
    needed: list[str] = []

    def need(text: str) -> None:
        for dep in re.findall(r"\bv_[a-z_]+\b", text):
            if dep in views.DUCK and dep not in needed:
                need(views.DUCK[dep])
                needed.append(dep)

    need(body)
    ctes = [f"{n} as ({views.plain(views.DUCK[n])})" for n in needed]
    match = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if match:
        rest = body[match.end():]
        return "with recursive " + ", ".join([*ctes, rest])
    return ("with " + ", ".join(ctes) + " " if ctes else "") + body
