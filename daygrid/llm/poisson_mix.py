"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of all characters, times ``epochs``, over the share it has: the mean number of copies
of its documents. A document's count is the inverse of the Poisson distribution of that rate at a number in [0, 1) that a
seeded hash of its id draws, so every run gives the same copies. Up to a rate of ``LARGE`` the distribution is a table;
beyond it the inverse is the Cornish-Fisher expansion of the Poisson quantile (off by one in less than 1 % of draws), so
the work for a count does not grow with the rate. Documents are exploded by their counts and put in the global order of
a second hash.

Counts follow ids: rows of one id get the same count. A null id is hashed as its text. A null source is a source of its
own, a null text has no characters. A source without any characters has rate ``epochs``. Weights are of sources; those
not named get ``other``. Extra columns stay; ``copy`` and ``order_key`` are added (or replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm import shared

SEED = 20
LARGE = 200
MOST_SENT = 5_000  # sources whose rates (3 KB at most) are sent to all executors; beyond that rows are joined by source and salt
SALTS = 64
PIECE = 4096  # copies made of one row at a time

#: Acklam's rational form of the inverse normal distribution, off by 1.2e-9 at most. Fixed values.
_CENTRE = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
_CENTRE_BELOW = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
_TAIL = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_BELOW = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)
_EDGE = 0.02425


def _polynomial(values: tuple[float, ...], x: str) -> str:
    out = f"{values[0]!r}::DOUBLE"
    for v in values[1:]:
        out = f"({out} * {x} + {v!r}::DOUBLE)"
    return out


def large_steps(u: str, rate: str) -> list[tuple[str, str]]:
    """Columns that lead, one after the other, to ``__k``: the inverse Poisson distribution of a large rate at ``u``.

    SQL for Spark and DuckDB alike. Each step reads the one before, so no expression is copied into the next.
    """
    low = f"__p < {_EDGE}::DOUBLE"
    middle = f"__p BETWEEN {_EDGE}::DOUBLE AND {1 - _EDGE!r}::DOUBLE"
    return [
        ("__p", f"GREATEST({u}, 1e-17::DOUBLE)"),
        ("__t", f"CASE WHEN {middle} THEN (__p - 0.5::DOUBLE) * (__p - 0.5::DOUBLE) WHEN {low} THEN SQRT(-2 * LN(__p)) ELSE SQRT(-2 * LN(1 - __p)) END"),
        ("__z", f"CASE WHEN {middle} THEN (__p - 0.5::DOUBLE) * {_polynomial(_CENTRE, '__t')} / {_polynomial(_CENTRE_BELOW, '__t')} "
                f"ELSE CASE WHEN {low} THEN 1 ELSE -1 END * {_polynomial(_TAIL, '__t')} / {_polynomial(_TAIL_BELOW, '__t')} END"),
        ("__k", f"CAST(GREATEST(FLOOR({rate} + SQRT({rate} + 1 / 12.0::DOUBLE) * __z + (__z * __z - 1) / 6.0::DOUBLE"
                f" + (__z - __z * __z * __z) / (72.0::DOUBLE * SQRT({rate})) + 0.5::DOUBLE), 0) AS BIGINT)")]


def _draw(kind: str, seed: int):
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    return F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.lit(kind), name, *([F.col("copy").cast("string")] if kind == "order" else [])).cast("binary"))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """(source, rate, upto): mean copies of each source and, up to ``LARGE``, its Poisson distribution, cumulated."""
    sums = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("double")).alias("chars"))
    weight = F.lit(float(other))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    sums = sums.withColumn("weight", weight)
    total = sums.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))  # one row
    rate = F.when(F.col("chars") > 0, F.col("weight") / F.col("all_weight") * epochs * F.col("all_chars") / F.col("chars")).otherwise(F.lit(float(epochs)))
    rated = sums.crossJoin(F.broadcast(total)).select("source", rate.alias("rate"))
    most = "cast(ceil(rate + 12 * sqrt(rate) + 24) as int)"
    # log p(k) = log p(k - 1) + ln(rate) - ln(k), so that large rates do not underflow
    logs = f"transform(sequence(1, {most}), k -> ln(rate) - ln(k))"
    return rated.withColumn("steps", F.expr(f"if(rate > 0 AND rate <= {LARGE}, {logs}, array())")).withColumn("upto", F.expr(f"""
      if(rate > 0 AND rate <= {LARGE}, aggregate(steps, named_struct('l', -rate, 's', exp(-rate), 'a', array(exp(-rate))), (t, x) ->
        named_struct('l', t.l + x, 's', t.s + exp(t.l + x), 'a', array_append(t.a, t.s + exp(t.l + x)))).a, array(1D))""")).drop("steps")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs``, each as often as drawn, in the order of ``order_key``; ``copy`` counts from 1."""
    columns = [c for c in docs.columns if c not in ("copy", "order_key")]
    table = shared.written(rates(docs, weights, other, epochs).select(
        F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("upto").alias("__upto")), "rates")
    if table.count() <= MOST_SENT:
        joined = docs.join(F.broadcast(table), docs["source"].eqNullSafe(F.col("__source")))
    else:
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = docs.withColumn("__own", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, left["source"].eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__salt")))
    drawn = F.conv(F.substring(_draw("count", seed), 1, 13), 16, 10).cast("double") / float(1 << 52)
    counted = joined.withColumn("__u", drawn)
    for name, step in large_steps("__u", "__rate"):
        counted = counted.withColumn(name, F.when(F.col("__rate") > LARGE, F.expr(step)))
    count = F.expr(f"CASE WHEN __rate <= {LARGE} THEN CAST(size(filter(__upto, c -> c <= __u)) AS BIGINT) ELSE __k END")
    counted = counted.withColumn("__n", count).filter("__n > 0")
    pieces = counted.select(*[F.col(f"`{c}`") for c in columns], "__n", F.explode(F.expr(f"sequence(0L, (__n - 1) div {PIECE})")).alias("__piece"))
    copies = pieces.select(*[F.col(f"`{c}`") for c in columns], F.explode(F.expr(f"sequence(__piece * {PIECE} + 1, least(__n, (__piece + 1) * {PIECE}))")).alias("copy"))
    return copies.withColumn("order_key", _draw("order", seed)).repartitionByRange("order_key").sortWithinPartitions("order_key")
