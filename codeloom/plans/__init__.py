"""The registered queries: each pairs a Spark plan with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and SQL.
MODULES = ["vectors", "metrics", "stats", "structure", "texts", "files", "components", "history", "budget", "streams", "snapshot_changes"]


def _collect(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"codeloom.plans.{m}"), name)
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_sql() -> dict:
    return _collect("SQL")


def flagship(spark, base):
    return all_queries()["vector_topk"](spark, base)
