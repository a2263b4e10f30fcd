"""The dense day spine every recurrence and run needs: one row per cell and day, gaps as NULL."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


Ranges = Sequence[tuple[str, str, str]]  # source, first day, last day


def spine(cells: DataFrame, ranges: Ranges, key: str = "cell_id") -> DataFrame:
    """Every cell on every day of every source: exploded from the cells, no join."""
    held = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b"))
                     for s, a, b in ranges])
    each = cells.select(key, F.inline(held))
    return each.select("source", key, F.explode(F.sequence("a", "b")).alias("day"))


#: Dense rows a task is given; each takes some 200 bytes in an aggregate.
TASK_ROWS = 400_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into as many parts as ``rows`` dense rows need, and no fewer than keep every core at work.

    A few packed rows become many in the same task, so their bytes on the way say nothing of the size of that task: the
    number is always given, because parts that Spark counts itself are merged again by their bytes.
    """
    return df.repartition(parts_of(df, rows), *keys)


def parts_of(df: DataFrame, rows: int) -> int:
    """Parts for ``rows`` dense rows of ``df``."""
    spark = df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(-(-rows // TASK_ROWS), least)


def dense_rows(cells: DataFrame, ranges: Ranges) -> int:
    """Rows of the spine of these cells."""
    return cells.count() * sum((date.fromisoformat(b) - date.fromisoformat(a)).days + 1 for _, a, b in ranges)


def densify(values: DataFrame, cells: DataFrame, ranges: Ranges, names: Sequence[str], key: str = "cell_id") -> DataFrame:
    """Values on the dense spine, in one shuffle by (source, cell), or by cell where there is one source.

    Spine and values are stacked and merged by an aggregate instead of joined:
    an aggregate on (source, cell, day) accepts rows hashed by (source, cell),
    and so do the windows and groups per cell that come next, which then need
    no shuffle of their own. The spine travels as one row per cell and range
    and is exploded to days where it arrives. Neither side is ever broadcast.

    Two rows of one cell and day are an error: no row is made up of both. Rows
    of other cells, or outside the ranges, are left out.
    """
    held = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(a).cast("date").alias("day"), F.lit(b).cast("date").alias("_last"))
                     for s, a, b in ranges])
    whole = cells.select(key, F.inline(held)).select("source", key, "day", "_last", *[F.lit(None).cast("double").alias(n) for n in names])
    both = whole.unionByName(values.select("source", key, "day", F.lit(None).cast("date").alias("_last"), *names))
    # Rows of one source are hashed by the key alone, which steps that know no source accept as well.
    by = ("source", key) if len({s for s, _, _ in ranges}) > 1 else (key,)
    here = spread(both, dense_rows(cells, ranges), *by)
    each = here.select(
        "source", key, F.explode(F.sequence("day", F.coalesce("_last", "day"))).alias("day"), *names,
        F.col("_last").isNull().cast("int").alias("_given"), F.col("_last").isNotNull().cast("int").alias("_held"))
    merged = each.groupBy("source", key, "day").agg(
        *[F.max(n).alias(n) for n in names], F.sum("_given").alias("_given"), F.max("_held").alias("_held"))
    twice = F.raise_error(F.concat(F.lit("two rows of one cell and day: "), F.col(key).cast("string"), F.lit(" "), F.col("day").cast("string")))
    single = F.when(F.col("_given") > 1, twice.cast("boolean")).otherwise(True)
    return merged.filter((F.col("_held") == 1) & single).drop("_given", "_held")
