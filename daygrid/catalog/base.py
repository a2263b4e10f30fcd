"""Registry of queries: one callable and, where SQL can say it, its SQL twin.

A column spec ("day:d cell_id:i tas:3") fixes names, types and rounding once
for both sides: ``s`` string, ``i`` long, ``b`` boolean, ``d`` ISO day as
string, ``f`` double as is, a digit a double rounded to so many decimals.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.catalog.tables import PRELUDE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []

# Added before flooring so that exact ties fall the same way whatever the order
# in which the two engines added the values up.
TIE = 1e-6


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "i":
        return c.cast("long").alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    if kind in "sd":
        return c.cast("string").alias(name)
    if kind == "f":
        return (c.cast("double") + F.lit(0.0)).alias(name)  # no minus zero
    scale = float(10 ** int(kind))
    return (F.floor(c.cast("double") * scale + 0.5 + TIE) / scale).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN) AS {name}"
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "d":
        return f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}"
    if kind == "f":
        return f"CAST({name} AS DOUBLE) + CAST(0 AS DOUBLE) AS {name}"
    scale = float(10 ** int(kind))
    return f"FLOOR(CAST({name} AS DOUBLE)*{scale} + 0.5 + {TIE:.7f})/{scale} AS {name}"


def _needed(text: str, extra: dict[str, str]) -> list[str]:
    """Names of the shared tables the text reads, in order of definition."""
    found: set[str] = set()
    todo = [text, *extra.values()]
    while todo:
        here = todo.pop()
        for name in PRELUDE:
            if name not in found and re.search(rf"\b{name}\b", here):
                found.add(name)
                todo.append(PRELUDE[name])
    return [name for name in PRELUDE if name in found]


def doubles(text: str) -> str:
    """Decimal literals as doubles, so that both engines compute in binary floating point."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", text)


def compose(cols: str, sql: str, parts: dict[str, str], recursive: bool = False) -> str:
    ctes = {n: PRELUDE[n] for n in _needed(sql, parts)} | parts
    if not ctes:
        with_ = ""
    else:
        with_ = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(
            f"{n} AS MATERIALIZED ({t[13:]})" if t.startswith("MATERIALIZED ") else f"{n} AS ({t})"
            for n, t in ctes.items()) + "\n"
    picked = ", ".join(_sql_column(*c.split(":")) for c in cols.split())
    return doubles(f"{with_}SELECT {picked} FROM ({sql}) AS answer")


def query(name: str, cols: str, sql: str | None = None, *, headline: bool = False,
          recursive: bool = False, **parts: str):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # Rows dealt by some of a join's keys meet where they lie (``operators.grid.DEALT``).
            spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
            out = fn(Tables(spark, sf_dir))
            return out.select(*[_spark_column(*c.split(":")) for c in cols.split()])

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(cols, sql, parts, recursive)
        if headline:
            HEADLINE.append(name)
        return fn

    return keep
