"""Snow under many settings at once: days by settings as a matrix for each snow year, no row multiplied.

The stock is empty on each 1 August, so a (station, snow year) is a unit of its own: rows are hashed by station and sorted by
day, and a task works through them unit by unit. In a unit the closed form of the stock (running sum less its running
minimum) is taken over all settings together; only the counts of its winter leave the task, one row per unit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.calendar import in_snow_season, snow_year
from daygrid.operators.snow import TIE_MM, Melt
from daygrid.operators.years import MILLIONTHS


@dataclass(frozen=True)
class Setting:
    """One trial: its labels, its degree-day numbers, and the columns it reads.

    ``warm`` names a column with the mean air of the days before; ``ground`` mm per degree of it melt as well.
    """

    labels: dict[str, float | str]
    melt: Melt = field(default_factory=Melt)
    tas: str = "tas"
    ground: float = 0.0
    warm: str | None = None


def warm_column(tas: str, days: int, keys: Sequence[str]) -> Column:
    """Mean air of the ``days`` days before each day (fewer at the start of a series), unknown where one of them is not finite.

    The difference of two running sums, in whole millionths: their frames only grow, so a day costs the same for any ``days``.
    """
    def until(back: int, what: str) -> Column:
        by = ", ".join(f"`{k}`" for k in keys)
        return F.expr(f"{what} OVER (PARTITION BY {by} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '{back}' DAY PRECEDING)")

    def of_days(what: str) -> Column:
        return until(1, what) - F.coalesce(until(days + 1, what), F.lit(0))

    finite = f"abs(`{tas}`) < double('infinity')"  # false for NaN, which Spark puts above all numbers
    total = of_days(f"sum(CASE WHEN {finite} THEN CAST(rint(`{tas}` * {MILLIONTHS}D) AS BIGINT) END)")
    known, odd = of_days(f"count(`{tas}`)"), of_days(f"count_if(NOT {finite})")
    return F.when(odd > 0, F.lit(float("nan"))).when(known > 0, total / known / MILLIONTHS)


def _counts(settings: Sequence[Setting], columns: dict[str, np.ndarray]) -> np.ndarray:
    """Days of one snow year that are known, in the season and under snow, by setting."""
    rain, none = np.nan_to_num(columns["_pr"]), np.zeros(len(columns["_pr"]))
    fall = cache(lambda tas, fall_c: np.where(columns[tas] < fall_c, rain, 0.0))
    melt = cache(lambda tas, mm: np.where(columns[tas] > 0, columns[tas] * mm, 0.0))
    warmth = cache(lambda tas, warm: np.where(np.isnan(columns[tas]), 0.0, np.maximum(np.nan_to_num(columns[warm]), 0.0)) if warm else none)
    # Settings that differ by the level alone share one stock.
    kinds = {(s.tas, s.melt.fall_c, s.melt.mm_per_degree, s.ground, s.warm): None for s in settings}
    at = {k: n for n, k in enumerate(kinds)}
    move = np.array([fall(tas, c) - (melt(tas, mm) + ground * warmth(tas, warm)) for tas, c, mm, ground, warm in kinds])
    c = np.cumsum(move, 1)
    low = np.minimum.accumulate(c, 1)
    counted = (columns["_season"] > 0) & ~np.isnan(columns["_seen"])
    stock = (c - np.minimum(low, 0.0, out=low))[:, counted]
    of = [at[s.tas, s.melt.fall_c, s.melt.mm_per_degree, s.ground, s.warm] for s in settings]
    level = np.array([s.melt.stock_mm for s in settings], float)
    return np.count_nonzero(stock[of] >= (level - TIE_MM)[:, None], axis=1)


def trial_winters(df: DataFrame, settings: Sequence[Setting], keys: Sequence[str], observed: str, share: float = 0.95,
                  pr: str = "pr") -> DataFrame:
    """keys, winter, observed_days, snow_days and the labels of each setting, for the winters judged.

    ``df``: dense days with the columns the settings read and a flag ``observed``, null where no report is. A winter is
    judged if its 1 August is held and ``share`` of the calendar's days from November to April are reported; both sides
    count reported days only and are scaled to the whole winter. Rows without a key or a day take no part.
    """
    reads = sorted({s.tas for s in settings} | {s.warm for s in settings if s.warm})
    names = ["_pr", "_season", "_seen", "_opens", *reads]
    opens = (F.month("day") == config.SNOW_RESET_MONTH) & (F.dayofmonth("day") == 1)
    # A window brings the days of a key together and in order, and moves nothing where they lie so already.
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("day"))
    ready = df.dropna(subset=[*keys, "day"]).withColumn("_nth", nth).select(
        *keys, "_nth", snow_year("day").cast("int").alias("winter"), "day", F.col(pr).cast("double").alias("_pr"),
        in_snow_season("day").cast("double").alias("_season"), F.col(observed).cast("double").alias("_seen"),
        opens.cast("double").alias("_opens"), *[F.col(n).cast("double").alias(n) for n in reads])
    unit = [*keys, "winter"]
    types = dict(ready.dtypes)
    schema = ", ".join([f"`{n}` {types[n]}" for n in unit] + ["_known int", "_snow int", "_counts array<int>"])

    def judged(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        values = {n: table.column(n).to_numpy() for n in names}
        rows, known, snow, counts = [], [], [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = {n: v[a:b] for n, v in values.items()}
            seen = part["_seen"][part["_season"] > 0]
            seen = seen[~np.isnan(seen)]
            if not len(seen) or not (part["_opens"] > 0).any():
                continue
            rows.append(a)
            known.append(len(seen))
            snow.append(int(seen.sum()))
            counts.append(_counts(settings, part).tolist())
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*[table.column(n).take(at).combine_chunks() for n in unit], pa.array(known, pa.int32()), pa.array(snow, pa.int32()),
             pa.array(counts, pa.list_(pa.int32()))], [*unit, "_known", "_snow", "_counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # rows of the last unit, which the next batch may go on with
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table]).combine_chunks()
            if not len(table):
                continue
            new = np.zeros(len(table) - 1, bool)
            for n in unit:
                v = table.column(n).to_numpy()
                new |= v[1:] != v[:-1]
            edges = np.r_[0, np.flatnonzero(new) + 1]
            left = table.slice(edges[-1])
            if len(edges) > 1:
                yield judged(table, edges)
        if left is not None and len(left):
            yield judged(left, np.array([0, len(left)]))

    winters = ready.mapInArrow(run, schema)
    days = F.datediff(F.make_date("winter", F.lit(4), F.lit(30)), F.make_date(F.col("winter") - 1, F.lit(11), F.lit(1))) + 1
    whole = winters.withColumn("_days", days).filter(F.col("_known") >= share * F.col("_days"))
    out = whole.select(*unit, "_days", "_known", (F.col("_snow") * F.col("_days") / F.col("_known")).alias("observed_days"),
                       F.posexplode("_counts").alias("_k", "_n"))
    labels = [F.element_at(F.array(*[F.lit(s.labels[n]) for s in settings]), F.col("_k") + 1).alias(n) for n in settings[0].labels]
    return out.select(*unit, "observed_days", (F.col("_n") * F.col("_days") / F.col("_known")).alias("snow_days"), *labels)


def trial_scores(winters: DataFrame, keys: Sequence[str], by: Sequence[str], least: Column | int = 1) -> DataFrame:
    """Error, bias and correlation over stations of mean counted and observed days, for each setting and part in ``by``.

    A station counts with ``least`` winters or more (15 to calibrate on and 10 to control on long series).
    """
    station = winters.groupBy(*keys, *by).agg(
        F.avg("snow_days").alias("_m"), F.avg("observed_days").alias("_o"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    gap = F.col("_m") - F.col("_o")
    return station.groupBy(*by).agg(
        F.avg(F.abs(gap)).alias("error"), F.avg(gap).alias("bias"), F.corr("_m", "_o").alias("correlation"),
        F.avg("_o").alias("observed"), F.avg("_m").alias("computed"), F.count("*").alias("stations"))
