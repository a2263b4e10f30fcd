"""Near duplicates: many universal hash minima, bands, signature and exact checks, connected components.

Texts with the same shingle set are one class and stand for each other. Classes meet in buckets of equal bands. First
every member of a bucket is held against the bucket's smallest id; what the signatures let pass is confirmed on the full
sets, and linked classes are joined to components. Then the members of buckets that still hold several components are
held against each other, block by block inside tasks, by their signatures; members that pass with one of another
component get their texts, and such pairs are confirmed on the full sets in the same blocks. What leaves a task is a
spanning set of its links, never its pairs. So no link is lost but by the bands (under 1e-5 for a pair right at the
threshold) and no bucket is written out as all its pairs.

Words are parted by white space, A-Z in lower case. A text with fewer words than a shingle has one shingle, the whole
sequence; one without words (or null) has none and is linked with nothing. Rows of one ``doc_id`` are one document. A
row without ``doc_id`` stands alone: its component is null and it is kept. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm import shared
from daygrid.llm.components import components

WORDS, PERCENT = 5, 80
BANDS, MISS = 32, 1e-5
ROWS_AT_ONCE = 1024
BLOCK = 1024  # members of a bucket held against each other in one task
SET_BITS = 54
#: Most ids sent to all executors to pick their texts; beyond that they are joined by a shuffle.
MOST_SENT = 1_000_000


def plan(percent: int, bands: int = BANDS, miss: float = MISS) -> tuple[int, int]:
    """(rows of a band, least equal minima): pairs right at the threshold fail either with less than ``miss``."""
    s = percent / 100
    rows = max(r for r in range(1, 17) if r == 1 or (1 - s**r) ** bands <= miss)
    k, p, below, least = rows * bands, s + (1 - s) / 256, 0.0, 0
    while p < 1 and below + (term := math.exp(math.lgamma(k + 1) - math.lgamma(least + 1) - math.lgamma(k - least + 1)
                                              + least * math.log(p) + (k - least) * math.log1p(-p))) <= miss:
        below, least = below + term, least + 1
    return rows, least


def shingle_sets(column, words: int):
    """Yields (first row, rows, n + 1 offsets, sorted distinct shingle hashes of each row) for slices of a text column."""
    data, offsets = shared.text_bytes(column)
    low = np.uint64((1 << SET_BITS) - 1)
    for a, b in shared.slices(offsets):
        for first in range(a, b, ROWS_AT_ONCE):
            last = min(b, first + ROWS_AT_ONCE)
            rows = offsets[first:last + 1] - offsets[first]
            piece = data[offsets[first]:offsets[last]]
            piece = np.where((piece >= 65) & (piece <= 90), piece + np.uint8(32), piece)
            inside = np.zeros(len(piece) + 2, bool)
            inside[1:-1] = ~((piece == 32) | ((piece >= 9) & (piece <= 13)))
            edge = np.zeros(len(piece) + 1, bool)
            edge[rows] = True
            starts = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
            ends = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
            one = shared.mixed(shared.spans_hashed(piece, starts, ends))
            bounds = np.searchsorted(starts, rows)
            held = np.diff(bounds)
            size = np.minimum(held, words)
            count = np.where(held > 0, held - size + 1, 0)
            row = np.repeat(np.arange(last - first), count)
            at = shared.ragged(bounds[:-1], count)
            value = np.full(len(at), words, np.uint64)
            for k in range(words):
                there = size[row] > k
                value = np.where(there, shared.mixed(value + one[np.minimum(at + k, max(len(one) - 1, 0))] if len(one) else value), value)
            value = np.where(size[row] < words, shared.mixed(value + np.uint64(1)), value)
            key = np.sort((row.astype(np.uint64) << np.uint64(SET_BITS)) | (value & low))
            key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
            yield first, last - first, np.searchsorted(key >> np.uint64(SET_BITS), np.arange(last - first + 1, dtype=np.uint64)), key & low


def signatures(docs: DataFrame, words: int, rows: int, bands: int = BANDS, seed: int = 1) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set), keys (one per band), sig (one byte per minimum)."""
    draw = np.random.default_rng(seed)
    times = draw.integers(0, 1 << 32, rows * bands, dtype=np.uint32) | np.uint32(1)
    plus = draw.integers(0, 1 << 32, rows * bands, dtype=np.uint32)

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            for first, n, offsets, sets in shingle_sets(batch.column("text"), words):
                sizes = np.diff(offsets)
                live = np.flatnonzero(sizes)
                begin = offsets[:-1][live]
                prints, keys, sigs = np.full(n, None, object), np.full(n, None, object), np.full(n, None, object)
                if len(live):
                    h = shared.mixed(sets)
                    both = np.stack([np.add.reduceat(h, begin), np.add.reduceat(shared.mixed(h), begin)], 1)
                    x = (h >> np.uint64(32)).astype(np.uint32)
                    minima = np.empty((len(live), rows * bands), np.uint32)
                    for k in range(rows * bands):
                        minima[:, k] = np.minimum.reduceat(x * times[k] + plus[k], begin)
                    key = np.tile(np.arange(bands, dtype=np.uint64), (len(live), 1))
                    for k in range(rows):
                        key = shared.mixed(key + minima[:, k::rows])
                    raw, signs = both.tobytes(), (minima & 0xFF).astype(np.uint8).tobytes()
                    prints[live] = [raw[16 * k:16 * k + 16] for k in range(len(live))]
                    sigs[live] = [signs[rows * bands * k:rows * bands * (k + 1)] for k in range(len(live))]
                    keys[live] = list(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, n).cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(list(prints), pa.binary()),
                    pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(sigs), pa.binary())], ["doc_id", "n_shingles", "set_hash", "keys", "sig"])
            shared.give_back()

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, set_hash binary, keys array<long>, sig binary")


def pick(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with (``left_semi``) or without (``left_anti``) their doc_id in ``ids``, a written table.

    Its ids are counted: up to ``MOST_SENT`` (8 MB) go to all executors, more are joined by a shuffle.
    """
    ids = ids.select(F.col("doc_id").alias("__id"))
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, docs["doc_id"] == F.col("__id"), how)


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    few, many = (x, y) if len(x) <= len(y) else (y, x)
    if not len(few) or 100 * len(few) < percent * len(many):
        return False
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    common = int((many[at] == few).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose full shingle sets are similar enough.

    Pairs are dealt by the hashes of both ends, and a text goes once to each deal that needs it: dense groups of pairs
    share texts, sparse pairs take two texts at most.
    """
    n = pairs.count()
    side = max(1, math.ceil(math.sqrt(n / 1000)))
    deal = [F.pmod(F.xxhash64(c), F.lit(side)).cast("int") for c in "ab"]
    dealt = pairs.select((deal[0] * side + deal[1]).alias("deal"), "a", "b")
    needed = dealt.select("deal", F.explode(F.array("a", "b")).alias("doc")).distinct()
    ids = shared.written(needed.select(F.col("doc").alias("doc_id")).distinct(), "ids")
    texts = pick(docs.select("doc_id", "text"), ids, "left_semi")
    texts = needed.join(texts, F.col("doc") == F.col("doc_id")).select("deal", "doc", "text")

    def check(key, texts, pairs):
        import pyarrow as pa

        names, sets = texts.column("doc").to_numpy(), {}
        for first, n, offsets, held in shingle_sets(texts.column("text"), words):
            for k in range(n):
                sets.setdefault(int(names[first + k]), []).append(held[offsets[k]:offsets[k + 1]])

        a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
        good = [any(alike(x, y, percent) for x in sets.get(u, ()) for y in sets.get(v, ())) for u, v in zip(a, b, strict=True)]
        shared.give_back()
        return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return texts.groupBy("deal").cogroup(dealt.withColumnRenamed("deal", "of").groupBy("of")).applyInArrow(check, "a long, b long")


def _alike(pairs: DataFrame, signs: DataFrame, least: int) -> DataFrame:
    """Pairs whose signatures agree in ``least`` places or more."""
    both = pairs.join(signs.select(F.col("doc").alias("a"), F.col("sig").alias("sig_a")), "a") \
        .join(signs.select(F.col("doc").alias("b"), F.col("sig").alias("sig_b")), "b")

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
            good = (x == y).sum(1) >= least if len(batch) else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(check, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """Members of buckets (bucket, doc, size, component) dealt to pairs of blocks of at most about ``BLOCK`` members."""
    block = F.pmod(F.xxhash64("doc"), F.col("blocks"))
    return members.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", block) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc", "component")


def _by_group(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows of each (bucket, x, y), streamed in order: a task holds one group at a time."""
    def stream(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            flat = [table.column(n).to_numpy() for n in ("bucket", "x", "y")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in flat], axis=0)) + 1
            edges = [0, *cut.tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    yield from work(table.slice(a, b - a)).to_batches()
            held = pa.concat_tables([table.slice(edges[-1])]).combine_chunks()
            del table, batch
            shared.give_back()
        if held is not None and len(held) > 1:
            yield from work(held).to_batches()

    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "doc").mapInArrow(stream, schema)


def _passing(table, least: int):
    """(i, places) of a group: members of other components, after i, whose signature agrees with that of i; a pair is
    told in the first of its buckets only."""
    x, y, bucket = (table.column(n)[0].as_py() for n in ("x", "y", "bucket"))
    block, component = table.column("block").to_numpy(), table.column("component").to_numpy()
    keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(len(table), -1)
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(table), -1)
    for i in range(len(table) - 1):
        other = component[i + 1:] != component[i]
        if x != y:
            other &= block[i + 1:] != block[i]
        at = np.flatnonzero(other) + i + 1
        at = at[(sig[at] == sig[i]).sum(1) >= least]
        if len(at):
            at = at[keys[i][(keys[at] == keys[i]).argmax(1)] == bucket]
        if len(at):
            yield i, at


def _inside(members: DataFrame, signs: DataFrame, docs: DataFrame, words: int, percent: int, least: int) -> DataFrame:
    """Links between members of one bucket that were in different components: a spanning set of each block's links."""
    schema = "bucket long, x long, y long, block long, doc long, component long, keys array<long>, sig binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def likely(table):
        import pyarrow as pa

        found = np.zeros(len(table), bool)
        for i, at in _passing(table, least):
            found[i] = True
            found[at] = True
        return table.select(names).filter(pa.array(found))

    def linked(table):
        import pyarrow as pa

        sets: list[np.ndarray] = []
        for _, n, offsets, held in shingle_sets(table.column("text"), words):
            sets += [held[offsets[k]:offsets[k + 1]] for k in range(n)]
        doc = table.column("doc").to_numpy()
        root = list(range(len(table)))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        found = []
        for i, at in _passing(table, least):
            for j in at:
                a, b = top(i), top(int(j))
                if a != b and alike(sets[i], sets[j], percent):
                    root[b] = a
                    found.append((int(doc[i]), int(doc[j])))
        out = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    dealt = _blocks(members).join(signs.select("doc", "keys", "sig"), "doc").select(*names)
    rows = shared.written(_by_group(dealt, likely, schema), "likely")
    ids = shared.written(rows.select(F.col("doc").alias("doc_id")).distinct(), "ids")
    texts = pick(docs.select("doc_id", "text"), ids, "left_semi")
    rows = rows.join(texts, F.col("doc") == F.col("doc_id")).select(*names, "text")
    return _by_group(rows, linked, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    rows, least = plan(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = shared.written(signatures(docs, words, rows), "signatures")
    known = signed.filter("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    classes = known.groupBy("set_hash").agg(F.min("doc_id").alias("doc"))
    signs = known.join(classes.withColumnRenamed("set_hash", "of"), (F.col("set_hash") == F.col("of")) & (F.col("doc_id") == F.col("doc")))
    signs = shared.written(signs.select("doc", "keys", "sig"), "classes")
    placed = signs.select("doc", F.explode("keys").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.min("doc").alias("first"), F.count("*").alias("size")).filter("size > 1")
    members = shared.written(placed.join(buckets, "bucket"), "members")
    pairs = members.filter("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    pairs = shared.written(_alike(pairs, signs, least), "pairs")
    links = shared.written(confirmed(pairs, docs, words, percent), "confirmed")
    joined = components(links)
    rest = members.filter("size > 2 AND doc <> first").join(joined, F.col("doc") == F.col("node"), "left") \
        .select("bucket", "doc", "size", F.coalesce("component", "doc").alias("component"))
    several = rest.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    more = shared.written(_inside(rest.join(several, "bucket"), signs, docs, words, percent, least), "confirmed")
    joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    ids = signed.select("doc_id", "n_shingles", "set_hash")
    grouped = ids.filter("doc_id IS NOT NULL AND set_hash IS NOT NULL") \
        .join(classes.withColumnRenamed("set_hash", "of"), F.col("set_hash") == F.col("of")) \
        .join(joined, F.col("doc") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc").alias("component_id"))
    alone = ids.filter("doc_id IS NULL OR set_hash IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
