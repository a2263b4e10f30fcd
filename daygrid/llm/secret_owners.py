"""Secrets found by patterns, and tokens judged by who holds them across the corpus.

Three kinds are found by pattern and always kept: values assigned to a name of a secret, access key ids, long hexadecimal
runs. Beyond them, long mixed tokens are candidates: each candidate's hash is counted over the corpus by distinct
repositories and owners. One that many owners hold is a copied example; one that few hold looks live and is added. A
candidate inside a pattern's match is that match; one that reaches beyond it is kept beside it, so that the whole
credential goes.

Positions are code points. They come from running sums of the lengths of matches and of what is between them, one row
per match. Work beyond the first scan is on distinct texts that hold a candidate at all, so copies cost nothing more and
a hot text is summed before it is moved. A null text is empty, null repositories and owners are not counted, repeated
rows stay, extra columns are ignored. Texts are scanned whole, whatever their length; matches of equal start are told in
the order of their kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.llm import shared

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs below the least length can hold no match of their own kind, so the length stands in the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
PATTERNS = (ASSIGN, ACCESS, HEX, TOKEN)
LEAST_VALUE = 6
#: A token is a candidate if it mixes small letters, capitals and digits, or if letters turn into digits often enough:
#: keys in one case do, words, dates and paths do not.
MIXED = "^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9])"
TURN, LEAST_TURNS = "[A-Za-z][0-9]", 3
WIDE_OWNERS = 3


def _matches(text):
    """(kind, pieces between matches, matches, values) for every kind."""
    def of(kind):
        p = F.lit(PATTERNS[kind])
        return F.struct(F.lit(kind).alias("kind"), F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, p, 0).alias("hits"),
                        F.regexp_extract_all(text, p, 2 if kind == 0 else 0).alias("values"))
    return F.array(*map(of, range(len(PATTERNS))))


def _may_hold(text):
    return text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(TOKEN)


def spans_of(texts: DataFrame) -> DataFrame:
    """Matches in the rows (key, text): key, kind, start, end and the hash of the value."""
    each = texts.select("key", F.explode(_matches(F.col("text"))).alias("m")).filter("size(m.hits) > 0") \
        .select("key", "m.kind", F.posexplode(F.arrays_zip("m.gaps", "m.hits", "m.values")).alias("n", "one"))
    before = Window.partitionBy("key", "kind").orderBy("n")
    placed = each.withColumn("end", F.sum(F.length("one.gaps") + F.coalesce(F.length("one.hits"), F.lit(0))).over(before)) \
        .filter("one.hits IS NOT NULL").select(
            "key", "kind", (F.col("end") - F.length("one.hits")).alias("start"), "end", F.col("one.values").alias("value"))
    varied = F.col("value").rlike(MIXED) | (F.size(F.regexp_extract_all("value", F.lit(TURN), 0)) >= LEAST_TURNS)
    fits = F.when(F.col("kind") == 0, F.length("value") >= LEAST_VALUE).when(F.col("kind") == 3, varied).otherwise(True)
    placed = placed.filter(fits)
    # a candidate token inside a pattern's match is that match; those before it in order begin no later
    base = F.col("kind") < 3
    order = Window.partitionBy("key").orderBy("start", "kind")
    ended = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("ended", ended).filter(base | (F.coalesce("ended", F.lit(0)) < F.col("end")))
    return placed.select("key", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                         F.unhex(F.md5(F.col("value").cast("binary"))).alias("value"))


def ownership(spans: DataFrame, holders: DataFrame) -> DataFrame:
    """Per value hash: distinct repositories and owners. ``holders``: key, repository, owner of every document."""
    held = spans.select("key", "value").distinct().join(holders.distinct(), "key").select("value", "repository", "owner").distinct()

    def counted(by):
        return held.filter(F.col(by).isNotNull()).select("value", by).distinct().groupBy("value").agg(F.count("*").alias(f"n_{by}"))

    return counted("repository").join(counted("owner"), "value", "full")


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", repository: str = "doc_id", owner: str = "source",
         wide_owners: int = WIDE_OWNERS, wide_repositories: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents as id and text key, spans by text key).

    A span has kind, start, end, the numbers of repositories and owners of its value, and ``copied``: many owners hold it,
    or, where ``wide_repositories`` is given, that many repositories.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    slim = shared.written(docs.select(
        F.col(key).alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"),
        text_key(t).alias("key"), F.when(_may_hold(t), t).alias("text")), "holders")
    texts = slim.filter("text IS NOT NULL").select("key", "text").dropDuplicates(["key"])
    spans = shared.written(spans_of(texts), "spans")
    owned = ownership(spans, slim.filter("text IS NOT NULL").select("key", "repository", "owner"))
    spans = spans.join(owned, "value", "left").fillna(0, ["n_repository", "n_owner"]) \
        .withColumn("copied", (F.col("n_owner") >= wide_owners) | (F.lit(False) if wide_repositories is None else F.col("n_repository") >= wide_repositories)) \
        .filter("kind < 3 OR NOT copied")
    return slim.select("doc_id", "key"), spans


def text_key(text):
    return F.unhex(F.md5(text.cast("binary")))


def _told(only):
    """The spans as kind:start:end by start, then kind, joined by commas."""
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    one = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("told"))
    return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(only, one))), lambda x: x["told"]))


def judged(docs: DataFrame, **names) -> DataFrame:
    """One row per document: counts by kind, spans as text, how many values look live, how many are copied
    widely, and the most repositories and owners that hold one of its values."""
    ids, spans = find(docs, **names)
    per_text = spans.groupBy("key").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k]}") for k in range(len(KINDS))],
        F.count(F.when(~F.col("copied"), 1)).alias("n_live"), F.count(F.when(F.col("copied"), 1)).alias("n_copied"),
        F.max("n_repository").alias("most_repositories"), F.max("n_owner").alias("most_owners"),
        _told(F.col("kind") < 3).alias("base"), _told(F.lit(True)).alias("spans"))
    counts = [f"n_{k}" for k in KINDS] + ["n_live", "n_copied", "most_repositories", "most_owners"]
    return ids.join(per_text, "key", "left").fillna(0, counts).fillna("", ["base", "spans"]).drop("key")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]", **names) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; rows and other columns as they are.

    Texts without a candidate pass by, the others are joined with their merged spans.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    _, spans = find(docs, text=text, **names)
    order = Window.partitionBy("key").orderBy("start", "end")
    fresh = (F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int")
    merged = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order)) \
        .groupBy("key", "run").agg(F.min("start").alias("a"), F.max("end").alias("b")) \
        .groupBy(F.col("key").alias("__key")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("__cut"))
    held = docs.filter(_may_hold(t)).withColumn("__key", text_key(t)).join(merged, "__key", "left").drop("__key")
    kept = F.expr(f"""concat(substring(`{text}`, 1, cast(__cut[0].a AS int)), array_join(transform(__cut, (c, k) -> concat('{mark}',
      if(k = size(__cut) - 1, substring(`{text}`, cast(c.b AS int) + 1), substring(`{text}`, cast(c.b AS int) + 1, cast(__cut[k + 1].a - c.b AS int))))), ''))""")
    held = held.withColumn(text, F.when(F.col("__cut").isNotNull(), kept).otherwise(F.col(text))).drop("__cut")
    return docs.filter(~_may_hold(t)).unionByName(held.select(*[F.col(f"`{c}`") for c in docs.columns]))
