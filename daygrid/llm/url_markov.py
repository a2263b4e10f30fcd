"""URL filter: rules on hosts and paths, and, where no rule fits, the ratio of two character language models.

One variable-order Markov model is counted over accepted URLs and one over rejected ones; orders are blended by
Witten-Bell smoothing. A URL's score is the mean over its characters of log2 p(rejected) - log2 p(accepted).

URLs are judged as host and path, runs of digits as one 0. What the models learn from: rejected are URLs whose host holds
one of ``SEEDS`` as a word; accepted are those without, unless a rule blocks them (a rule is policy, not style). No host
speaks for itself as accepted: hosts are dealt to ``FOLDS`` by a hash, and a URL is scored by the accepted URLs of the
other folds. So bad hosts that no list names stand out, though they were counted as accepted. The threshold is calibrated
as the middle between the medians of both kinds' held-out scores, zero at least (for it, rejected URLs are scored without
their own fold on either side; judged they are by all the rejected ones); medians stay where they are though some of the
accepted are bad. Everything is counted over all URLs; equal ones
are summed before they are cut to characters, and scored once.

A null URL, or one without ``://``, has an empty host and path, no rule, and is allowed: there is nothing to judge it by.
Repeated rows stay, equal URLs get equal scores, extra columns are ignored; a very long URL counts by all its characters.
Without URLs of both kinds nothing is rejected by the method.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.llm import shared

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SEEDS = ("casino", "pills", "bets", "spam", "adult", "porn", "viagra", "lottery")
ORDER = 4  # characters of context at most
FOLDS, GRID = 8, 0.05
START, END = "\u0002", "\u0003"
ALPHABET = 100.0  # equal chances below the shortest context
#: Rows of the table of n-grams that are sent to all executors (16 ratios each, about 30 MB); beyond that it is joined by a shuffle.
MOST_SENT = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url) -> tuple:
    """(host, path) of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules: Sequence[tuple[str, str]] = RULES) -> tuple:
    """(rule, verdict): the longest rule whose host is the URL's or above it and whose path begins the URL's; else null."""
    def fits(rule):
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)

    ordered = sorted(rules, key=lambda r: (len(r[0]), r[1] == "allow"))
    return tuple(reduce(lambda otherwise, r: F.when(fits(r[0]), F.lit(r[k])).otherwise(otherwise), ordered, F.lit(None).cast("string")) for k in (0, 1))


def _grams(texts: DataFrame) -> DataFrame:
    """One row per character of the distinct texts: the character after its context of ``ORDER`` characters."""
    whole = F.concat(F.lit(START * ORDER), "s", F.lit(END))
    return texts.withColumn("w", whole).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("s") + 1))) \
        .withColumn("gram", F.expr(f"substring(w, i, {ORDER + 1})")).drop("w", "i")


def ratios(grams: DataFrame, pairs: Sequence[tuple[str, str, str]] = (("ratio", "rejected", "accepted"),)) -> DataFrame:
    """(gram, ratio): log2 of both models' chances of the last character after the others.

    ``grams``: gram with a column of counts for each model; ``pairs`` are (name, rejecting model, accepting model). Counts
    of shorter contexts are sums of the longer ones'; all models meet a gram in the same joins.
    """
    sides = sorted({side for _, *two in pairs for side in two})
    out, chance = grams.select("gram"), {side: F.lit(1 / ALPHABET) for side in sides}
    for n in range(ORDER + 1):
        by = grams.groupBy(F.expr(f"right(gram, {n + 1})").alias(f"g{n}")).agg(*[F.sum(side).alias(f"{side}_{n}") for side in sides])
        held = by.groupBy(F.expr(f"left(g{n}, {n})").alias(f"h{n}")).agg(*[x for side in sides for x in (
            F.sum(f"{side}_{n}").alias(f"{side}_all{n}"), F.count(F.when(F.col(f"{side}_{n}") > 0, 1)).alias(f"{side}_kinds{n}"))])
        table = by.join(held, F.expr(f"left(g{n}, {n})") == F.col(f"h{n}")).drop(f"h{n}")
        out = out.join(table, F.expr(f"right(gram, {n + 1})") == F.col(f"g{n}"))
        blended = {}
        for side in sides:
            seen, total, kinds = F.col(f"{side}_{n}"), F.col(f"{side}_all{n}"), F.col(f"{side}_kinds{n}")
            blended[side] = F.when(total > 0, (seen + kinds * chance[side]) / (total + kinds)).otherwise(chance[side])
        out = out.select("gram", *[c.alias(f"_{side}") for side, c in blended.items()])
        chance = {side: F.col(f"_{side}") for side in sides}
    return out.select("gram", *[(F.log2(f"_{r}") - F.log2(f"_{a}")).alias(name) for name, r, a in pairs])


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages`` (page_id, url)."""
    host, path = parsed(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("rule", rule).withColumn("said", said) \
        .withColumn("s", F.regexp_replace(F.concat("host", F.lower("path")), "[0-9]+", "0"))
    seeded = F.col("host").rlike(f"(^|[^a-z])({'|'.join(seeds)})([^a-z]|$)") if seeds else F.lit(False)
    counted = pages.groupBy("s").agg(
        F.count(F.when(seeded, 1)).alias("rejected"), F.count(F.when(~seeded & ~F.coalesce(F.col("said") == "block", F.lit(False)), 1)).alias("accepted"))
    fold = F.expr(f"instr('0123456789abcdef', left(md5(substring_index(s, '/', 1)), 1)) % {FOLDS}")
    texts = shared.written(counted.filter("s <> ''").withColumn("fold", fold), "urls")
    # models of all folds but the k-th; the rejecting one of all folds judges, the others calibrate
    grams = _grams(texts).groupBy("gram").agg(F.sum("rejected").alias("rejected"), *[
        F.sum(F.when(F.col("fold") != k, F.col(kind)).otherwise(0)).alias(f"{kind}{k}") for kind in ("rejected", "accepted") for k in range(FOLDS)])
    pairs = [(f"score{k}", "rejected", f"accepted{k}") for k in range(FOLDS)] + [(f"held{k}", f"rejected{k}", f"accepted{k}") for k in range(FOLDS)]
    table = shared.written(ratios(shared.written(grams, "grams"), pairs), "ratios")
    held = F.broadcast(table) if table.count() <= MOST_SENT else table
    own = {x: F.element_at(F.array(*[f"{x}{k}" for k in range(FOLDS)]), F.col("fold").cast("int") + 1) for x in ("score", "held")}
    scores = _grams(texts).join(held, "gram").groupBy("s", "rejected", "accepted").agg(*[F.round(F.avg(v), 9).alias(x) for x, v in own.items()])
    scores = shared.written(scores, "scores")
    # both medians, on a grid of bounded length
    kinds = ("accepted", "rejected")
    steps = scores.groupBy(F.floor(F.col("held") / GRID).alias("step")).agg(*[F.sum(k).alias(k) for k in kinds])
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    whole = steps.crossJoin(F.broadcast(steps.agg(*[F.sum(k).alias(f"{k}_all") for k in kinds]))).select(
        "step", *[F.when(2 * F.sum(k).over(upto) >= F.col(f"{k}_all"), F.col("step")).alias(k) for k in kinds])
    limit = whole.agg(F.greatest((F.min("accepted") + F.min("rejected")) * GRID / 2, F.lit(0.0)).alias("limit"))
    both = scores.agg(F.max(F.col("rejected") > 0).alias("r"), F.max(F.col("accepted") > 0).alias("a"))
    limit = limit.crossJoin(F.broadcast(both)).select(F.when(F.col("r") & F.col("a"), F.col("limit")).alias("limit"))  # one row
    found = scores.select(F.col("s").alias("of"), "score")
    out = pages.join(found, F.col("s") == F.col("of"), "left").crossJoin(F.broadcast(limit))
    far = F.coalesce((F.col("score") >= F.col("limit")) & (F.col("score") > 0), F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(far, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
