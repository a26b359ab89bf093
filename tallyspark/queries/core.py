"""Registry of runnable queries and their reference SQL over the given tables.

A binding is plain SQL that both engines accept; it maps the given tables to an engine schema.
Table and binding names appear as ``{name}`` and are resolved per engine.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
BINDINGS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_NAME = re.compile(r"\{([a-z]\w*)\}")


def binding(name: str, sql: str) -> None:
    BINDINGS[name] = sql


def query(name: str, sql: str | None = None):
    """Register a Spark query; ``sql`` is its DuckDB counterpart (bindings become CTEs)."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = duckdb_text(sql)
        return fn
    return add


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in _NAME.findall(sql):
        if name in BINDINGS and name not in seen:
            _needed(BINDINGS[name], seen)
            seen.append(name)
    return seen


def duckdb_text(sql: str) -> str:
    ctes = [f"{n} as ({_NAME.sub(r'\1', BINDINGS[n])})" for n in _needed(sql, [])]
    body = _NAME.sub(r"\1", sql).strip()
    if not ctes:
        return body
    head = ",\n".join(ctes)
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[len('with '):]}"
    return f"with {head}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding as a DataFrame over the tables in ``sf_dir``."""
    return run_sql(spark, sf_dir, BINDINGS[name])


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tag = f"{zlib.crc32(sf_dir.encode()):08x}"

    def resolve(match):
        name = match.group(1)
        view = f"v_{tag}_{name}"
        df = (table if name in TABLES else bind)(spark, sf_dir, name)
        df.createOrReplaceTempView(view)
        return view

    return spark.sql(_NAME.sub(resolve, sql))
