"""Language by compression: the language whose text makes the best dictionary for a new text.

A model holds, per language, raw bytes of training texts as a zstandard dictionary. A text is cut to blocks, each block
is compressed with every dictionary by itself (so the dictionary counts over the whole length of the text), and the sums
are compared. The smallest wins; the margin to the second makes the score, and a narrow margin is told as rejected.

The dictionaries are made from a bounded sample: texts in the order of a hash, up to ``DICTIONARY`` bytes per language,
of a text longer than ``SAMPLE_TEXT`` bytes that much from ``PLACES`` drawn by hash. Their number is that of the languages;
so is that of the sampled texts, times a constant. Of a text only its runs of
letters count, in lower case. A null text, one without a letter, or any text where nothing could be learned is ``und`` with
score 0 and rejected. Ties go to the language with more training texts. Null languages are not learned, repeated rows stay, extra columns are ignored.
"""

from __future__ import annotations

import math

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
DICTIONARY = 48 << 10  # bytes of training text per language: the documented bound of the sample
SAMPLE_TEXT = 8 << 10  # of longer texts so many bytes are sampled, so that one text does not fill a dictionary
PLACES = 4  # pieces of a longer text, one from each of as many equal parts of it
BLOCK = 2 << 10
LEVEL = 6
NARROW = 0.02  # rejected below this share of bytes saved against the second language
SHARPNESS = 0.15  # score per byte of margin


def _sampled():
    """The text, or of a long one about ``SAMPLE_TEXT`` bytes: a piece from a place drawn by hash in each of its equal parts."""
    part = f"(char_length(text) div {PLACES})"
    wide = f"cast(floor(char_length(text) * {SAMPLE_TEXT / PLACES}D / n) as int)"
    pieces = [f"substring(text, cast({k} * {part} + 1 + pmod(xxhash64(h, {k}), greatest(1L, {part} - {wide} + 1)) as int), {wide})" for k in range(PLACES)]
    return F.expr(f"CASE WHEN n <= {SAMPLE_TEXT} THEN text ELSE concat_ws(' ', {', '.join(pieces)}) END")


def learn(labelled: DataFrame, size: int = DICTIONARY) -> dict[str, bytes]:
    """Per language, texts in the order of a hash up to ``size`` bytes; the language with most texts first."""
    order = Window.partitionBy("lang").orderBy("h", "n")
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.octet_length("text").alias("n")) \
        .filter("n > 0").withColumn("h", F.xxhash64("text"))
    # hashes and lengths are ranked, texts are fetched for the few that are taken; the rank is bounded, so tasks send few rows
    names = rows.select("lang", "h", "n").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, size // 64))
    before = F.coalesce(F.sum(F.least("n", F.lit(SAMPLE_TEXT))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = names.withColumn("before", before).filter(F.col("before") < size).select(F.col("lang").alias("l"), F.col("h").alias("k"))
    texts = rows.join(F.broadcast(taken), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k"))) \
        .withColumn("text", _sampled()).dropDuplicates(["lang", "h"])
    found: dict[str, list[str]] = {}
    for row in texts.orderBy("lang", "h", "n").select("lang", "text").collect():
        found.setdefault(row[0], []).append(row[1])
    often = {row[0]: row[1] for row in rows.groupBy("lang").count().collect()}  # a row per language
    return {lang: _plain("\n".join(found[lang]))[:size] for lang in sorted(found, key=lambda x: (-often[x], x))}


#: A letter is a character of category L; marks that follow belong to it.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def _plain(text: str) -> bytes:
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "replace")


def predict(docs: DataFrame, model: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score (0 to 1), margin and rejected."""
    langs = list(model)

    def scored(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        presses = []
        for lang in langs:
            held = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(model[lang]), write_content_size=0)
            held.precompute_compress(compression_params=how)
            presses.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress)
        for batch in batches:
            out = []
            for value in batch.column("text"):
                text = value.as_py()
                if text is None or not langs or not (raw := _plain(text)):
                    out.append((UNKNOWN, 0.0, 0.0, True))
                    continue
                blocks = [raw[k:k + BLOCK] for k in range(0, len(raw), BLOCK)]
                sizes = [sum(len(press(b)) for b in blocks) for press in presses]
                best = min(range(len(langs)), key=lambda k: (sizes[k], k))
                second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best] + 1)
                margin = 1 - sizes[best] / second
                out.append((langs[best], 1 / sum(math.exp(-SHARPNESS * min(4000, s - sizes[best])) for s in sizes), margin, margin < narrow))
            names, score, margins, rejected = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.array(score, float)), pa.array(np.array(margins, float)),
                pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scored, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
