"""The same dates of every year: figures, comparison with a reference, ranks, kinds.

Sums over date ranges come from running sums: a range costs two marks among
the days of its cell, whatever its length, instead of one row per day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.calendar import shifted
from daygrid.functions.classes import rain_class, temperature_class
from daygrid.functions.expr import half_even, half_even_of, ratio
from daygrid.operators.spine import spread
from daygrid.session import written

MILLIONTHS = 1e6

# The counts of a summary and their thresholds.
COUNTS: dict[str, tuple[str, str, float]] = {
    "hot_35": ("tasmax", ">=", 35.0),
    "hot_40": ("tasmax", ">=", 40.0),
    "tropical_nights": ("tasmin", ">", 20.0),
    "summer_days": ("tasmax", ">", 25.0),
    "frost_days": ("tasmin", "<", 0.0),
}


def _test(name: str, sign: str, value: float) -> Column:
    c = F.col(name)
    return {">=": c >= value, ">": c > value, "<": c < value}[sign]


def same_dates(requests: DataFrame, periods: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Each request's dates in every year, with the source holding them whole (NULL when none does)."""
    years = requests.withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    by = F.col("year") - F.year("first_day")
    moved = years.withColumns({"_a": shifted("first_day", by), "_b": shifted("last_day", by)}).drop(
        "first_day", "last_day", "source").withColumnsRenamed({"_a": "first_day", "_b": "last_day"})
    p = periods.select("source", F.col("first_day").alias("_from"), F.col("last_day").alias("_to"))
    held = (F.col("_from") <= F.col("first_day")) & (F.col("last_day") <= F.col("_to"))
    return moved.join(F.broadcast(p), held, "left").drop("_from", "_to")


def in_periods(daily: DataFrame, periods: DataFrame) -> DataFrame:
    """Days of each source inside its served period: running sums must not cross a hole in the days."""
    p = periods.select("source", F.col("first_day").alias("_from"), F.col("last_day").alias("_to"))
    return daily.join(F.broadcast(p), "source").filter(F.col("day").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def ranges_of_years(requests: DataFrame, daily: DataFrame, periods: DataFrame, first_year: int, last_year: int,
                    names: Sequence[str], flags: Mapping[str, Column], key: str = "cell_id") -> DataFrame:
    """Sums of each variable and counts of each flag over every request's dates in every year that a source holds whole.

    Days and requests meet in one shuffle by (source, cell): a request travels once for each source and is exploded to its
    years where it arrives. Each range puts a mark before its first day and one after its last into the cell's days; the
    running sums at the two marks give the range, and nothing wide travels again. Sums are whole millionths.
    """
    wide = [c for c in requests.columns if c not in ("first_day", "last_day", "source", key)]
    p = periods.select("source", F.col("first_day").alias("_from"), F.col("last_day").alias("_to"))
    asked = requests.drop("source").filter(F.col(key).isNotNull()).crossJoin(F.broadcast(p)).select(
        "source", key, F.lit(None).cast("date").alias("day"),
        F.struct("first_day", "last_day", "_from", "_to", *[F.col(c).alias(f"_{i}") for i, c in enumerate(wide)]).alias("_r"))
    measured = {f"s_{n}": F.rint(F.col(n) * MILLIONTHS).cast("long") for n in names}
    measured |= {f"n_{n}": F.col(n).isNotNull().cast("int") for n in names}
    measured |= {f"c_{k}": F.coalesce(c, F.lit(False)).cast("int") for k, c in flags.items()}
    known = daily.filter(F.coalesce(*names).isNotNull() & F.col(key).isNotNull())  # a gap adds to no sum
    rows = known.select("source", key, "day", *names).unionByName(asked, allowMissingColumns=True)
    many = requests.count() * (last_year - first_year + 1) // 2
    here = spread(rows, many, "source", key).withColumn("_id", F.monotonically_increasing_id())
    first = F.year("_r.first_day")
    no_mark = F.struct(F.lit(None).cast("int").alias("year"), F.lit(None).cast("date").alias("a"), F.lit(None).cast("date").alias("b"))
    dates = F.transform(F.sequence(F.lit(first_year), F.lit(last_year)), lambda y: F.struct(
        y.alias("year"), shifted(F.col("_r.first_day"), y - first).alias("a"), shifted(F.col("_r.last_day"), y - first).alias("b")))
    whole = F.filter(dates, lambda d: (F.col("_r._from") <= d["a"]) & (d["b"] <= F.col("_r._to")))
    marks = F.when(F.col("_r").isNull(), F.array(F.struct(no_mark.alias("d"), F.lit(0).alias("sign")))).otherwise(F.flatten(F.transform(
        whole, lambda d: F.array(F.struct(d.alias("d"), F.lit(-1).alias("sign")), F.struct(d.alias("d"), F.lit(1).alias("sign"))))))
    marked = here.withColumn("_m", F.explode(marks))
    # a mark stands before the days from its first one on, and after its last one
    at = F.when(F.col("_m.sign") < 0, F.col("_m.d.a")).when(F.col("_m.sign") > 0, F.col("_m.d.b")).otherwise(F.col("day"))
    marked = marked.withColumns({"_at": at, "_sign": F.col("_m.sign")})
    w = W.partitionBy("source", key).orderBy("_at", "_sign").rowsBetween(W.unboundedPreceding, 0)
    upto = marked.select("source", key, "_id", "_r", F.col("_m.d").alias("_d"), "_sign", *[F.sum(v).over(w).alias(c) for c, v in measured.items()])
    flat = upto.filter(F.col("_sign") != 0).select(
        "source", key, "_id", F.col("_d.year").alias("year"), F.col("_d.a").alias("first_day"), F.col("_d.b").alias("last_day"),
        *[F.col(f"_r._{i}").alias(f"_{i}") for i in range(len(wide))], "_sign", *measured)
    by = ["source", key, "_id", "year", "first_day", "last_day", *[f"_{i}" for i in range(len(wide))]]
    # a range that lies before every known day of its cell has no sum, and adds nothing
    got = flat.groupBy(*by).agg(*[F.coalesce(F.sum(F.col("_sign") * F.col(c)), F.lit(0)).alias(c) for c in measured])
    return got.drop("_id").withColumnsRenamed({f"_{i}": c for i, c in enumerate(wide)})


def _mean(name: str) -> Column:
    return F.when(F.col(f"n_{name}") > 0, F.col(f"s_{name}") / F.col(f"n_{name}") / MILLIONTHS)


def _served(name: str) -> Column:
    """The mean as it is shown, to one decimal: from the whole sum and the count, so that x.x5 is a tie and nothing else is."""
    n = F.col(f"n_{name}")
    return F.when(n > 0, half_even_of(f"s_{name}", F.when(n > 0, n) * int(MILLIONTHS / 10)) / 10.0)


def year_figures(requests: DataFrame, daily: DataFrame, periods: DataFrame, first_year: int, last_year: int,
                 key: str = "cell_id") -> DataFrame:
    """One row per request and year: mean temperatures, rain, counts of days scaled to the whole range.

    A gap is not a dry day nor a day under a threshold: sums are means times days.
    """
    names = ("tasmax", "tasmin", "tas", "pr")
    flags = {k: _test(*v) for k, v in COUNTS.items()}
    requests = written(requests)  # read by the years held, the years that are not, and the count of parts
    got = ranges_of_years(requests, in_periods(daily, periods), periods, first_year, last_year, names, flags, key)
    size = F.datediff("last_day", "first_day") + 1
    got = got.withColumn("days", size)
    out = {"tasmax_mean": _mean("tasmax"), "tasmax_served": _served("tasmax"), "tas_mean": _mean("tas"), "precipitation": _mean("pr") * F.col("days")}
    for k, (name, _, _) in COUNTS.items():
        out[k] = F.when(F.col(f"n_{name}") > 0, F.col(f"c_{k}") * F.col("days") / F.col(f"n_{name}"))
    dated = same_dates(requests, periods, first_year, last_year)
    figures = got.select(*dated.columns, "days", *[v.alias(k) for k, v in out.items()])
    # Years that no source holds whole, and ranges without a cell, have no day to meet.
    unmet = dated.filter(F.col("source").isNull() | F.col(key).isNull()).withColumn("days", size)
    return figures.unionByName(unmet.select(*dated.columns, "days", *[F.lit(None).cast(dict(figures.dtypes)[k]).alias(k) for k in out]))


FIGURES = ("tasmax_mean", "tas_mean", "precipitation", *COUNTS)


def compare(figures: DataFrame, request: str, reference: int | Column, years: int = config.REFERENCE_YEARS) -> DataFrame:
    """Anomaly, standard deviations, ratio and classes of each year against the reference years."""
    w = W.partitionBy(request)
    inside = F.col("year").between(reference, reference + years - 1)
    out = figures.withColumns({
        "temperature_normal": F.avg(F.when(inside, F.col("tas_mean"))).over(w),
        "temperature_sigma": F.stddev_samp(F.when(inside, F.col("tas_mean"))).over(w),
        "precipitation_normal": F.avg(F.when(inside, F.col("precipitation"))).over(w)})
    anomaly = F.col("tas_mean") - F.col("temperature_normal")
    out = out.withColumns({
        "temperature_anomaly": anomaly, "temperature_sigmas": ratio(anomaly, "temperature_sigma"),
        "precipitation_ratio": ratio("precipitation", "precipitation_normal")})
    # The last bits of a mean must not decide a class.
    return out.withColumns({"temperature_class": temperature_class(half_even("temperature_sigmas", 9)),
                            "precipitation_class": rain_class(half_even("precipitation_ratio", 9))})


def rounded(years: DataFrame) -> DataFrame:
    """What is shown: rules above read the full values."""
    one = ("tas_mean", "temperature_anomaly", "precipitation", "temperature_normal", "precipitation_normal")
    two = ("temperature_sigmas", "precipitation_ratio", "temperature_sigma")
    return years.withColumns({n: half_even(n, 1) for n in one} | {n: half_even(n, 2) for n in two})


def summary(figures: DataFrame, request: str, shown_year: Column, reference: int | Column,
            years: int = config.REFERENCE_YEARS, observed: str = "era5") -> DataFrame:
    """Figures of the dates shown beside their mean over the reference years, one row per request and figure."""
    inside = F.col("year").between(reference, reference + years - 1) & (F.col("source") == observed)
    own = F.col("year") == shown_year
    wide = figures.groupBy(request).agg(
        *[F.max(F.when(own, F.col(n))).alias(n) for n in FIGURES],
        *[F.avg(F.when(inside, F.col(n))).alias(f"normal_{n}") for n in FIGURES])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("figure"), F.col(n).alias("value"), F.col(f"normal_{n}").alias("normal")) for n in FIGURES]))
    return wide.select(request, pairs.alias("p")).select(request, "p.*")


def rank(figures: DataFrame, request: str, shown_year: Column, observed: str = "era5", named: int = config.NAMED_YEARS
         ) -> DataFrame:
    """How many observed years were warmer than the year shown, itself left out; named when few."""
    known = figures.filter("tasmax_mean IS NOT NULL").withColumn("_own", F.col("year") == shown_year)
    w = W.partitionBy(request)
    with_shown = known.withColumn("_shown", F.max(F.when(F.col("_own"), F.col("tasmax_mean"))).over(w))
    others = with_shown.filter(F.col("_shown").isNotNull() & ~F.col("_own") & (F.col("source") == observed))
    warm = F.col("tasmax_mean") > F.col("_shown")
    out = others.groupBy(request).agg(
        F.min("year").alias("first"), F.max("year").alias("last"), F.count("*").alias("total"),
        F.count_if(warm).alias("warmer"), F.array_sort(F.collect_list(F.when(warm, F.col("year")))).alias("_years"))
    return out.withColumn("warmer_years", F.when(F.col("warmer") <= named, F.col("_years")).otherwise(
        F.array().cast("array<int>"))).drop("_years")


def with_epoch(figures: DataFrame, epochs=config.EPOCHS) -> DataFrame:
    epoch = F.lit(None).cast("string")
    for name, first, last in epochs:
        epoch = F.when(F.col("year").between(first, last), name).otherwise(epoch)
    return figures.withColumn("epoch", epoch).filter("epoch IS NOT NULL")


def kinds(figures: DataFrame, request: str, epochs=config.EPOCHS, share: float = config.KIND_SHARE,
          simulated: str = config.SIMULATED) -> DataFrame:
    """Each year of an epoch as cool, normal or warm by its mean maximum; the epoch's origin, NULL if mixed."""
    known = with_epoch(figures, epochs).filter("tasmax_mean IS NOT NULL")
    w = W.partitionBy(request, "epoch")
    n = F.count("*").over(w)
    k = F.greatest(F.lit(1), half_even(share * F.col("_n")).cast("int"))
    out = known.withColumns({
        "_n": n, "_rank": F.row_number().over(w.orderBy("tasmax_mean", "year")),
        "_lo": F.min("source").over(w), "_hi": F.max("source").over(w)})
    kind = (F.when(2 * k >= F.col("_n"), "normal").when(F.col("_rank") <= k, "cool")
            .when(F.col("_rank") > F.col("_n") - k, "warm").otherwise("normal"))
    origin = F.when(F.col("_lo") == F.col("_hi"), F.when(F.col("_lo") == simulated, "simulated").otherwise("observed"))
    return out.withColumns({"kind": kind, "origin": origin}).drop("_n", "_rank", "_lo", "_hi")


def cut_days(requests: DataFrame, daily: DataFrame, periods: DataFrame, first_year: int, last_year: int, request: str,
             names: Sequence[str], key: str = "cell_id") -> DataFrame:
    """The days of each request's dates in every year (at most 92 rows to a year), by an equi join."""
    dated = same_dates(requests, periods, first_year, last_year).filter("source IS NOT NULL")
    days = dated.select(request, key, "source", "year", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return days.join(daily.select("source", key, "day", *names), ["source", key, "day"])


def extreme_days(days: DataFrame, request: str, epochs=config.EPOCHS) -> DataFrame:
    """Hottest day and coldest night of each epoch: the later year on a tie, the first day inside it."""
    early = -F.unix_date("day")
    hot = F.max_by(F.struct("year", "day", F.col("tasmax").alias("value")),
                   F.when(F.col("tasmax").isNotNull(), F.struct("tasmax", "year", early.alias("e"))))
    cold = F.max_by(F.struct("year", "day", F.col("tasmin").alias("value")),
                    F.when(F.col("tasmin").isNotNull(), F.struct((-F.col("tasmin")).alias("v"), "year", early.alias("e"))))
    g = with_epoch(days, epochs).groupBy(request, "epoch").agg(hot.alias("h"), cold.alias("c"))
    return g.select(request, "epoch", F.col("h.year").alias("hot_year"), F.col("h.day").alias("hot_day"),
                    half_even("h.value", 1).alias("hot_value"), F.col("c.year").alias("cold_year"),
                    F.col("c.day").alias("cold_day"), half_even("c.value", 1).alias("cold_value"))


def records(ranked: DataFrame, request: str, sign: int = 1, by: Sequence[str] = ("epoch",)) -> DataFrame:
    """The year of the highest (or lowest) served value (one decimal) of an epoch, the later one on a tie."""
    served = ranked.withColumn("tasmax_mean", F.col("tasmax_served"))
    best = F.max_by(F.struct("year", "tasmax_mean"), F.struct((sign * F.col("tasmax_mean")).alias("v"), "year"))
    return served.groupBy(request, *by).agg(best.alias("b")).select(
        request, *by, F.col("b.year").alias("record_year"), F.col("b.tasmax_mean").alias("record_value"))


def another(ranked: DataFrame, request: str, shown: Column, seed: int = 0) -> DataFrame:
    """One year of each kind other than the one shown, drawn by a seeded hash (the same at every run)."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(request), F.col("epoch"), F.col("year")).cast("binary"))
    return ranked.filter(F.col("year") != shown).groupBy(request, "epoch", "kind").agg(
        F.min_by("year", draw).alias("year"))


def typical(figures: DataFrame, request: str, first: int, last: int, shown: Column,
            min_years: int = config.TYPICAL_MIN_YEARS) -> DataFrame:
    """The year whose served value (one decimal) is nearest the mean of those of first..last, the later on a tie,
    never the one shown; none with few values."""
    kept = figures.withColumn("tasmax_mean", F.col("tasmax_served")).filter(F.col("year").between(first, last) & F.col("tasmax_mean").isNotNull())
    w = W.partitionBy(request)
    scored = kept.withColumns({"_mean": F.avg("tasmax_mean").over(w), "_n": F.count("*").over(w)}).filter(
        (F.col("_n") >= min_years) & (F.col("year") != shown))
    gap = F.abs(F.col("tasmax_mean") - F.col("_mean"))
    best = F.min_by(F.struct("year", "tasmax_mean", "_mean"), F.struct(F.floor(gap * 1e9 + 0.5).alias("g"), (-F.col("year")).alias("y")))
    return scored.groupBy(request).agg(best.alias("b")).select(
        request, F.col("b.year").alias("year"), F.col("b.tasmax_mean").alias("value"), F.col("b._mean").alias("mean"))


def record_card(ranked: DataFrame, peaks: DataFrame, requests: DataFrame, request: str,
                shown_epochs: tuple[str, str] = ("old", "future")) -> DataFrame:
    """The record offered beside a season: the hottest season of the future (in winter, the coldest of
    the past), or its extreme day when that season is the one shown.

    ``requests`` has season and shown_year, and shown_kind (NULL when none).
    """
    past, future = shown_epochs
    want = F.when(F.col("season") == "winter", past).otherwise(future)
    asked = requests.select(request, "season", "shown_year", "shown_kind", want.alias("epoch"))
    hot = records(ranked, request, 1).withColumnsRenamed({"record_year": "_hy", "record_value": "_hv"})
    cold = records(ranked, request, -1).withColumnsRenamed({"record_year": "_cy", "record_value": "_cv"})
    met = asked.join(hot, [request, "epoch"]).join(cold, [request, "epoch"]).join(peaks, [request, "epoch"], "left")
    winter = F.col("season") == "winter"
    year, value = F.when(winter, F.col("_cy")).otherwise(F.col("_hy")), F.when(winter, F.col("_cv")).otherwise(F.col("_hv"))
    day_kind = F.when(winter, "coldestDay").otherwise("hottestDay")
    peak = F.when(winter, F.struct(F.col("cold_year").alias("y"), F.col("cold_day").alias("d"), F.col("cold_value").alias("v"))
                  ).otherwise(F.struct(F.col("hot_year").alias("y"), F.col("hot_day").alias("d"), F.col("hot_value").alias("v")))
    out = met.withColumns({"_year": year, "_value": value, "_kind": day_kind, "_peak": peak})
    same = F.col("_year") == F.col("shown_year")
    out = out.filter(~same | (F.col("_peak.y").isNotNull() & (F.coalesce("shown_kind", F.lit("")) != F.col("_kind"))))
    return out.select(
        request, "epoch", F.when(same, F.col("_kind")).otherwise(F.when(winter, "coldRecord").otherwise("record")).alias("kind"),
        F.when(same, F.col("_peak.y")).otherwise(F.col("_year")).alias("year"),
        F.when(same, F.col("_peak.d")).alias("day"),
        F.when(same, F.col("_peak.v")).otherwise(F.col("_value")).alias("value"))
