"""All queries of the library and their oracles. A query is (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("text_queries", "source_queries", "segment_queries", "relational_queries", "verify_queries", "reduce_queries", "log_queries")


def query(name: str, oracle: str | None = None):
    """Registers a query, with DuckDB SQL for the same rows where SQL can express them."""

    def put(function):
        assert name not in _QUERIES, name
        _QUERIES[name] = function
        if oracle:
            _ORACLES[name] = oracle
        return function

    return put


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"scriptoria.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A common table expression with literal rows, for oracles over inline fixtures."""

    def show(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            parts = [f"chr({ord(c)})" if ord(c) < 32 else c for c in v]
            if any(p.startswith("chr(") for p in parts):
                out, text = [], ""
                for c, p in zip(v, parts, strict=True):
                    if ord(c) < 32:
                        out += ["'" + text.replace("'", "''") + "'", p]
                        text = ""
                    else:
                        text += c
                return "(" + " || ".join([*out, "'" + text.replace("'", "''") + "'"]) + ")"
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)})"
