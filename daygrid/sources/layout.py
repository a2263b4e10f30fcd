"""The two stored copies of the daily table, and reading from them.

``points`` serves long series of few cells, ``maps`` serves few days of many
cells. Both are range-partitioned on their full sort key, so no task ever holds
a whole cell, block or year: a hot cell is simply cut into several files, and
Parquet row-group statistics prune on the sort key.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.expr import gap
from daygrid.session import cut, written
from daygrid.sources import manifest as M


def between(first: date | str | None, last: date | str | None, day: str = "day") -> Column:
    out = F.lit(True)
    if first is not None:
        out = out & (F.col(day) >= F.lit(first).cast("date"))
    if last is not None:
        out = out & (F.col(day) <= F.lit(last).cast("date"))
    return out


def read_daily(df: DataFrame, source: str | None = None, names: Sequence[str] = config.MEASURES,
               first: date | str | None = None, last: date | str | None = None) -> DataFrame:
    """Chosen variables of one source over a date range; the year filter prunes the map copy."""
    if source is not None:
        df = df.filter(F.col("source") == source)
    df = df.filter(between(first, last))
    if "year" in df.columns:
        if first is not None:
            df = df.filter(F.col("year") >= int(str(first)[:4]))
        if last is not None:
            df = df.filter(F.col("year") <= int(str(last)[:4]))
    return df.select("source", "cell_id", "day", *[clean(df, n) for n in names])


def clean(df: DataFrame, name: str) -> Column:
    """A stored column as it is used: NaN is a gap."""
    return gap(name).alias(name) if dict(df.dtypes)[name] in ("float", "double") else F.col(name)


def write_points(df: DataFrame, path: str, partitions: int | None = None) -> None:
    keys = ("source", "cell_id", "day")
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("source").parquet(path)


def write_maps(df: DataFrame, path: str, partitions: int | None = None) -> None:
    keys = ("source", "year", "day", "cell_id")
    df = df.withColumn("year", F.year("day"))
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("source", "year").parquet(path)


def read_copy(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[clean(df, n) for n in df.columns])


def _path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _increment(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``missing_years`` and their manifest, which is counted again only for pairs that met rows of the copy."""
    spark, df = df.sparkSession, df.withColumn("year", F.year("day"))
    if not _path_exists(spark, path):
        return df, M.manifest(df)
    pair, keys = ["source", "year"], ["source", "cell_id", "day"]
    here = written(M.manifest(df))  # a row per pair
    maybe = written(M.unlike(here, M.stored(spark, path, _path_exists)))
    # Pairs that the copy has no row of are taken as they are; only the others meet its rows.
    copy = spark.read.parquet(path)
    shared = written(maybe.join(copy.select(*pair).distinct(), pair, "left_semi"))
    # Small enough to be sent, and the copy's folders are named by its columns: Spark prunes them at run time.
    held, some = copy.join(F.broadcast(shared), pair, "left_semi"), df.join(F.broadcast(shared), pair, "left_semi")
    years = written(some.select(*keys, "year").join(held.select(*keys), keys, "left_anti").select(*pair).distinct())
    # Cut from the files that are about to be replaced.
    own = cut(held.join(F.broadcast(years), pair, "left_semi").join(some.select(*keys), keys, "left_anti"))
    new = maybe.join(shared, pair, "left_anti")
    both = df.join(F.broadcast(years), pair, "left_semi").unionByName(own)
    told = here.join(new, pair, "left_semi").unionByName(M.manifest(both))
    return df.join(F.broadcast(new.unionByName(years)), pair, "left_semi").unionByName(own), told


def missing_years(df: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """All rows of the (source, year) pairs the stored copy lacks or holds in part.

    A pair is missing as long as one of its cell-days is; rows that only the copy holds are kept with it. Pairs that the
    manifest of the copy tells to be equal are not read; only the others meet the copy's rows.
    """
    return _increment(df, path)[0]


def write_years(df: DataFrame, path: str) -> None:
    """Write the missing years only; each year's files replace that year alone, then its manifest row is replaced.

    ``df`` is read several times: one that is dear to build is handed over written (``session.written``).
    """
    todo, told = _increment(df, path)
    (todo.repartitionByRange("source", "year", "day", "cell_id").sortWithinPartitions("source", "year", "day")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source", "year").parquet(path))
    M.write(told, path)
