"""A table of searches answered at once: days, normals, climate, years, summary, kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.calendar import SEASON_STARTS, mid_year
from daygrid.functions.expr import half_even
from daygrid.operators import climate as C
from daygrid.operators import normals as N
from daygrid.operators import years as Y

# The order in which a search can be refused.
REFUSALS = ("UnknownReference", "EmptyRange", "RangeTooLong", "OutsideDomain", "BadElevation", "Unavailable")


def constants() -> dict:
    """What a client needs to know before asking: periods, references, edges, epochs."""
    return {
        "periods": [{"source": s, "first_day": a.isoformat(), "last_day": b.isoformat(), "origin": o}
                    for s, a, b, o in config.PERIODS],
        "references": [{"first": y, "last": y + config.REFERENCE_YEARS - 1} for y in config.REFERENCES],
        "band_edges": list(config.BAND_EDGES), "max_days": config.MAX_DAYS,
        "epochs": [{"id": i, "first": a, "last": b} for i, a, b in config.EPOCHS],
        "elevation": [config.MIN_ELEVATION_M, config.MAX_ELEVATION_M],
        "refusals": list(REFUSALS),
    }


def answers(searches: DataFrame, daily: DataFrame, periods: DataFrame, reference: int = config.REFERENCES[-1],
            years: int = config.REFERENCE_YEARS, span: int = config.CLIMATE_SPAN, first_year: int = config.FIRST_YEAR,
            last_year: int = config.LAST_YEAR, observed: str = "era5", simulated: str = config.SIMULATED,
            references: Sequence[int] | None = None, epochs=config.EPOCHS) -> dict[str, DataFrame]:
    """Every answer to every accepted search (search_id, cell_id, first_day, last_day), as lazy tables; ``years`` unrounded (see ``years.rounded``).

    A column ``reference`` gives each search its own reference period, one of ``references``; without it all have ``reference``.
    """
    asked = searches.drop("source").withColumn("shown", F.year("first_day"))
    if "reference" not in asked.columns:
        asked = asked.withColumn("reference", F.lit(reference))
    known = references if references is not None else (reference,)
    past = daily.filter(F.col("source") == observed)
    names = ("tasmax", "tasmin", "pr")
    figures = Y.year_figures(asked, daily, periods, first_year, last_year)
    own = F.col("reference")
    sums = C.month_sums(daily, ["source", "cell_id"])
    middle = asked.withColumn("mid", mid_year("first_day", "last_day")).select("search_id", "cell_id", "mid")
    normals = N.pooled_by_reference(past, names, ["cell_id"], known, years)
    return {
        "normals": N.of_ranges(normals, asked, "search_id", ["cell_id", "reference"], names),
        "climate": C.rounded(C.window_diagram(sums, C.windows(middle, periods, "mid", span), ["source", "cell_id"], "search_id")),
        "years": Y.compare(figures, "search_id", own, years),
        "summary": Y.summary(figures, "search_id", F.col("shown"), own, years, observed),
        "rank": Y.rank(figures, "search_id", F.col("shown"), observed),
        "kinds": Y.kinds(figures, "search_id", epochs, simulated=simulated),
    }


def sentences(summary: DataFrame, searches: DataFrame, request: str) -> DataFrame:
    """One line of text per search out of its summary rows."""
    pick = lambda n: F.max(F.when(F.col("figure") == n, F.col("value")))
    g = summary.groupBy(request).agg(
        half_even(pick("tasmax_mean"), 1).alias("tx"), F.rint(pick("hot_35")).cast("long").alias("hot"),
        F.rint(pick("frost_days")).cast("long").alias("frost"))
    when = F.concat_ws(" / ", F.date_format("first_day", "yyyy-MM-dd"), F.date_format("last_day", "yyyy-MM-dd"))
    warm = F.when(F.col("tx").isNotNull(), F.format_string(" : mean maximum %.1f °C", "tx")).otherwise("")
    count = (F.when(F.col("hot") > 0, F.format_string(", %d day(s) at 35 °C or more", "hot"))
             .when(F.col("frost") > 0, F.format_string(", %d day(s) of frost", "frost")).otherwise(""))
    return searches.select(request, "first_day", "last_day").join(g, request).select(
        request, F.concat(when, warm, count).alias("sentence"))


#: Added to every text about simulated days.
NOT_A_FORECAST = "Simulation: plausible weather, not a forecast."


def title(first: str = "first_day", last: str = "last_day"):
    """The season and its year or years where the dates are one (from a 21st to the 20th three months later), else the dates."""
    start = F.month(first) * 100 + F.dayofmonth(first)
    name = F.coalesce(*[F.when(start == day, F.lit(word.capitalize())) for day, word in SEASON_STARTS])
    years = F.year(last) - F.year(first)
    whole = (F.dayofmonth(last) == 20) & (F.pmod(F.month(last) - F.month(first), F.lit(12)) == 3) & (years <= 1)
    shown = F.when(years == 0, F.year(first).cast("string")).otherwise(F.concat_ws("-", F.year(first), F.year(last)))
    dates = F.concat_ws(" to ", F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd"))
    return F.when(name.isNotNull() & whole, F.concat_ws(" ", name, shown)).otherwise(dates)


def page_texts(summary: DataFrame, searches: DataFrame, request: str, reference: str, simulated: str = config.SIMULATED) -> DataFrame:
    """Title and sentence of each search: mean maximum with its gap to the normal, hot or else frosty days, the notice on
    simulated days. ``searches``: request, first_day, last_day, source and, where there is one, the place's name."""
    of = lambda n, c="value": F.max(F.when(F.col("figure") == n, F.col(c)))
    g = summary.groupBy(request).agg(
        of("tasmax_mean").alias("_tx"), of("tasmax_mean", "normal").alias("_normal"),
        F.rint(of("hot_35")).cast("long").alias("_hot"), F.rint(of("frost_days")).cast("long").alias("_frost"))
    gap = half_even(F.round(F.col("_tx") - F.col("_normal"), 9), 1)
    warm = F.format_string("mean maximum %.1f °C", half_even(F.round("_tx", 9), 1))
    against = F.when(F.col("_normal").isNotNull(), F.concat(
        F.lit(" ("), F.when(gap >= 0, "+").otherwise("-"), F.format_string("%.1f °C against ", F.abs(gap)), F.lit(f"{reference})"))).otherwise("")
    counted = lambda c, words: F.concat(F.format_string("%d day", c), F.when(F.col(c) > 1, "s").otherwise(""), F.lit(words))
    parts = F.concat_ws(", ", F.when(F.col("_tx").isNotNull(), F.concat(warm, against)),
                        F.when(F.col("_hot") > 0, counted("_hot", " at 35 °C or more")).when(F.col("_frost") > 0, counted("_frost", " of frost")))
    place = F.substring(F.trim("name"), 1, 80) if "name" in searches.columns else F.lit(None).cast("string")
    told = searches.join(g, request, "left").withColumn("title", F.concat_ws(" at ", title(), F.when(place != "", place)))
    notice = F.when(F.col("source") == simulated, f" {NOT_A_FORECAST}").otherwise("")
    return told.select(request, "title", F.concat("title", F.when(parts != "", F.concat(F.lit(": "), parts)).otherwise(""), F.lit("."), notice).alias("sentence"))
