"""Quality rules by distance of distributions: a text's signs and common words against those of its language.

Base rules: too few words, or too many words inside eight-word windows that a text holds twice or more. Beyond them, the
histogram of character classes and that of common words are compared with the histograms of the whole language (sums
over all texts of that language) by the Jensen-Shannon distance (base 2, 0 to 1); short texts are not judged by them.

Everything is worked out inside a row by built-in functions, but for the language sums, one small aggregate. A null text
has no words. A null language, or one without common words, is compared by what there is. Repeated rows stay, extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm import shared

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Character classes; what is in none of them (letters with accents, other scripts) is a class of its own.
CLASSES = {"small": "a-z", "capital": "A-Z", "digit": "0-9", "white": shared.SPACES, "stop": ".,;:!?'\"()-", "sign": "#*$%&|<>@+/=_~^{}\\[\\]`\\\\"}
#: Frequent function words of the languages.
COMMON = {
    "en": "the of and to in is that for with was on by as at this be from are".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au".split(),
    "es": "de la que el en y a los se del las un por con no una su para".split(),
}
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_CHARS, MIN_COMMON_WORDS = 200, 60
MAX_CLASS_DISTANCE = 0.3
#: The rest holds four fifths of both histograms, so prose stays far below 1: a text without one common word of its language
#: is at 0.31 to 0.32, a clean one of 100 words or more below 0.24.
MAX_WORD_DISTANCE = 0.26


def words_of(text):
    """Words of a text column; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{shared.SPACES}]+"), "")


def _less(text, pattern: str):
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``words`` and the base counts. Each step is a projection of its own, so that arrays are made once."""
    t = F.coalesce(F.col(text), F.lit(""))
    line_with_word = f"[^{shared.SPACES}]"
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(line_with_word))
    n_symbols = sum((F.length(t) - F.length(F.replace(t, F.lit(c))) for c in SYMBOLS), F.lit(0))
    df = docs.withColumn("words", words_of(F.col(text))).withColumn("lines", lines)
    df = df.withColumns({
        "n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": n_symbols.cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "h1": F.transform("words", lambda w: F.xxhash64(w))}).drop("lines")
    for one, two, step in (("h1", "h2", 1), ("h2", "h4", 2), ("h4", "h8", 4)):  # hashes of 2, 4 and 8 words from each place
        df = df.withColumn(two, F.when(F.size(one) > step, F.expr(
            f"transform(sequence(0, size({one}) - {step + 1}), i -> xxhash64({one}[i], {one}[i + {step}]))"))).drop(one)
    # texts with no window twice are done; of the others, windows are sorted to bring equal ones together
    df = df.withColumn("placed", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.expr(
        "array_sort(transform(h8, (h, i) -> named_struct('h', h, 'i', i)))"))).drop("h8")
    df = df.withColumn("at", F.expr(
        "array_sort(transform(filter(placed, (p, k) -> (k > 0 and placed[k - 1].h = p.h) or (k < size(placed) - 1 and placed[k + 1].h = p.h)), p -> p.i))")).drop("placed")
    covered = F.expr(f"aggregate(transform(at, (a, k) -> if(k = size(at) - 1, {WINDOW}, least({WINDOW}, at[k + 1] - a))), 0L, (s, x) -> s + x)")
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def histograms(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` (with ``words``) with ``classes`` and ``common``, arrays of counts; the last entry counts the rest."""
    t = F.coalesce(F.col(text), F.lit(""))
    named = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    size = len(next(iter(COMMON.values())))
    df = df.withColumns({f"c_{k}": _less(t, f"[{v}]+") for k, v in CLASSES.items()} | {"listed": F.try_element_at(named, F.coalesce(F.col(lang), F.lit("")))})
    counts = [F.col(f"c_{k}") for k in CLASSES]
    df = df.withColumn("frequent", F.when(F.col("listed").isNotNull(), F.expr("filter(words, w -> array_contains(listed, w))")))
    df = df.withColumns({
        "classes": F.array(*counts, F.length(t) - sum(counts, F.lit(0))),
        "common": F.when(F.col("listed").isNotNull(), F.array(
            *[F.size("frequent") - F.size(F.array_remove("frequent", F.col("listed")[k])) for k in range(size)], F.size("words") - F.size("frequent")))})
    return df.drop("listed", "frequent", *[f"c_{k}" for k in CLASSES])


def distance(a: str, b: str):
    """Jensen-Shannon distance of two count arrays of one length; null where one of them is empty."""
    return F.expr(f"""
      CASE WHEN aggregate({a}, 0D, (s, x) -> s + x) > 0 AND aggregate({b}, 0D, (s, x) -> s + x) > 0 THEN sqrt(greatest(0D, aggregate(
        zip_with(transform({a}, x -> x / aggregate({a}, 0D, (s, y) -> s + y)), transform({b}, x -> x / aggregate({b}, 0D, (s, y) -> s + y)),
          (p, q) -> (if(p > 0, p * log2(2 * p / (p + q)), 0D) + if(q > 0, q * log2(2 * q / (p + q)), 0D)) / 2), 0D, (s, x) -> s + x))) END""")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_class: float = MAX_CLASS_DISTANCE,
           max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row per row of ``docs``: key, language, base counts, both distances, and the verdicts."""
    counted = histograms(base_counts(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))))
    counted = shared.written(counted.drop("words", "text"), "rules")  # counts only; read twice below
    entries = len(CLASSES) + 1, len(next(iter(COMMON.values()))) + 1
    sums = counted.filter("lang IS NOT NULL").groupBy("lang").agg(
        *[F.sum(F.col(c)[k].cast("double")).alias(f"{c}{k}") for c, n in zip(("classes", "common"), entries, strict=True) for k in range(n)])
    reference = sums.select(F.col("lang").alias("of"), *[
        F.array(*[F.coalesce(F.col(f"{c}{k}"), F.lit(0.0)) for k in range(n)]).alias(f"{c}_reference")
        for c, n in zip(("classes", "common"), entries, strict=True)])
    out = counted.join(reference, F.col("lang") == F.col("of"), "left").withColumns({
        "class_distance": distance("classes", "classes_reference"), "word_distance": distance("common", "common_reference")})
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = ((F.col("word_chars") >= MIN_CHARS) & (F.col("class_distance") > max_class)) | \
        ((F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("word_distance") > max_word))
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
