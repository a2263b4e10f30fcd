"""Prefix trie of conversations: which beginnings are shared, by how many, and what sharing them saves.

A turn's id is the first 16 bytes of the SHA-256 of its role and text (two turns of 10^12 share one with a chance of
10^-15). A conversation's key is its ids in a row. Keys are dealt to tasks by range of (key, conv_id), so a beginning
that a third of all conversations share, or a conversation that a third repeat, is spread over many tasks. Each task
builds adaptive radix trees over runs of at most ``RUN`` keys or ``RUN_BYTES`` bytes and walks them; only byte depths
that end a turn give nodes.

Nodes inside a run are whole. Those on the way to a run's first or last key may go on in the next run: their figures
are sums, and what two neighbouring runs both count is taken back along the beginning that the last key of the one and
the first of the other share. One task holds a run's keys: 16 bytes a turn, so at least one whole conversation's ids,
never texts.

Rows without conv_id take no part. Null role or text is empty. Rows of one turn go by role, then id. No rows: no nodes.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.llm import shared
from daygrid.llm.radix_tree import Tree

WIDTH = 16
RUN = 20_000
RUN_BYTES = 1 << 24
#: A beginning's children find it in this many copies, so that none of its copies meets all of them.
COPIES = 16
NONE = hashlib.sha256(b"").hexdigest()
_NODES = ("conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
          "node binary, parent binary, edge boolean, part int, run int, ends string, key binary, words binary, is_last boolean")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), id, words: one row per turn, without its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH).alias("id"),
        F.regexp_count(text, F.lit(f"[^{shared.SPACES}]+")).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "id")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "id", "words")


def keys(placed: DataFrame) -> DataFrame:
    """conv_id, key, words (4 bytes a turn) from rows of ``turns``."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "words"))),
                         lambda t: F.struct(t["id"].alias("id"), F.unhex(F.lpad(F.hex(t["words"].cast("long")), 8, "0")).alias("words")))
    rows = placed.groupBy("conv_id").agg(packed.alias("t"))
    return rows.select("conv_id", *[F.expr(f"coalesce(array_join(transform(t, x -> hex(x.{c})), ''), '')").alias(c) for c in ("id", "words")]) \
        .select("conv_id", F.unhex("id").alias("key"), F.unhex("words").alias("words"))


def _chain(key: bytes, depth: int) -> list[bytes]:
    """Names of the nodes of depths 0 to ``depth`` on the way to a key."""
    names = [hashlib.sha256(b"").digest()[:WIDTH]]
    for d in range(depth):
        names.append(hashlib.sha256(names[-1] + key[d * WIDTH:(d + 1) * WIDTH]).digest()[:WIDTH])
    return names


def _counts(words: bytes) -> list[int]:
    return [int.from_bytes(words[k:k + 4]) for k in range(0, len(words), 4)]


def _shared_depth(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // WIDTH
    return next((d for d in range(n) if a[d * WIDTH:(d + 1) * WIDTH] != b[d * WIDTH:(d + 1) * WIDTH]), n)


def _walk(rows, part, run):
    """Nodes of the tree of one run of (key, conv_id, words) rows in ascending order."""
    tree = Tree()
    for key, _, _ in rows:
        tree.insert(key)
    seen, todo = [], [(tree.root, 0, -1)]  # by first visit
    while todo:
        node, start, above = todo.pop()
        end = start + len(node.path)
        seen.append((node, start, end, above))
        todo += [(c, end + 1, len(seen) - 1) for c in reversed(node.children())]
    # sums over what is below, filled from the last visited to the first
    least: list = [None] * len(seen)
    tops, leaves, saved = [0] * len(seen), [0] * len(seen), [0] * len(seen)
    figures: list = [()] * len(seen)
    for k in range(len(seen) - 1, -1, -1):
        node, start, end, above = seen[k]
        own = [rows[n][1] for n in range(node.first, node.first + node.ends)]
        least[k] = min(c for c in (*own[:1], least[k]) if c is not None)
        words, found = rows[node.first][2], []
        for d in range(end // WIDTH, -(-start // WIDTH) - 1 if above >= 0 else -1, -1):
            children = 1 if found else tops[k]
            leaves[k] = leaves[k] if children else 1
            saved[k] += (node.last - node.first) * int.from_bytes(words[4 * d - 4:4 * d]) if d else 0
            found.append((d, children, leaves[k], saved[k], own if d * WIDTH == end else ()))
        if found:
            tops[k] = 1
        figures[k] = found
        if above >= 0:
            tops[above], leaves[above], saved[above] = tops[above] + tops[k], leaves[above] + leaves[k], saved[above] + saved[k]
            least[above] = least[k] if least[above] is None else min(least[above], least[k])
    names = {at: _chain(rows[at][0], len(rows[at][0]) // WIDTH) for at in (0, len(rows) - 1)}
    holders = [(None, None, False)] * len(seen)  # conv_id, name, edge of the last node above
    for k, (node, _, _, above) in enumerate(seen):
        up = holders[above] if above >= 0 else (None, None, False)
        edge = node.first == 0 or node.last == len(rows) - 1
        path = names[0] if node.first == 0 else names[len(rows) - 1] if edge else None
        for d, children, leaves, saved, own in reversed(figures[k]):
            name = path[d] if edge else None
            ends = ",".join(map(str, own))
            yield (least[k], d, None if up[2] else up[0], node.last - node.first + 1, children, leaves, saved,
                   None if edge else hashlib.sha256(ends.encode()).hexdigest(), name, up[1] if up[2] else None, edge, part, run,
                   ends if edge and own else None, None, None, None)
            up = (least[k], name, edge)
        holders[k] = up


def _taken_back(last, first):
    """What two neighbouring runs both count, from the last row of the one and the first of the other."""
    depth = _shared_depth(last[0], first[0])
    names, counts = _chain(first[0], depth), _counts(first[2][:4 * depth])
    again = -1 if len(last[0]) == depth * WIDTH else 0
    saved = sum(counts)
    for d in range(depth + 1):
        yield (None, d, None, 0, -1 if d < depth else 0, again, saved, None, names[d], names[d - 1] if d else None, True, None, None, None, None, None, None)
        saved -= counts[d - 1] if d else 0


def _batch(rows):
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary()),
                        ("edge", pa.bool_()), ("part", pa.int32()), ("run", pa.int32()), ("ends", pa.string()), ("key", pa.binary()), ("words", pa.binary()),
                        ("is_last", pa.bool_())])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _in_batches(rows, most=20_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _runs(batches, run_keys):
    """Rows in runs of bounded number and bytes."""
    held, size = [], 0
    for batch in batches:
        for key, conv, words in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "words"))):
            held.append((key, conv, words))
            size += len(key)
            if len(held) == run_keys or size >= RUN_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _trees(run_keys):
    def work(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows():
            last, number = None, -1
            for number, held in enumerate(_runs(batches, run_keys)):
                yield from _walk(held, part, number)
                if last is None:
                    yield _end(held[0], part, number, False)
                else:
                    yield from _taken_back(last, held[0])
                last = held[-1]
            if last is not None:
                yield _end(last, part, number, True)

        yield from _in_batches(rows())

    return work


def _end(row, part, run, is_last):
    return (*[None] * 10, True, part, run, None, row[0], row[2], is_last)


def _between(batches):
    def rows():
        for batch in batches:
            for a, b, w in zip(*(batch.column(c).to_pylist() for c in ("last_key", "key", "words"))):
                yield from _taken_back((a,), (b, None, w))

    yield from _in_batches(rows())


def _hashed(batches):
    """One SHA-256 per node over pieces in order; memory holds one batch of pieces."""
    import pyarrow as pa

    now, digest = None, None
    for batch in batches:
        nodes, hashes = [], []
        for node, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if node != now:
                if digest is not None:
                    nodes.append(now)
                    hashes.append(digest.hexdigest())
                now, digest = node, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], ["node", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])


def trie(keyed: DataFrame, run_keys: int = RUN) -> DataFrame:
    """Nodes of the trie of rows (conv_id, key, words).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes
    below, itself included), saved_tokens, ends_sha256 (of the ids of the conversations that end there, ascending,
    joined by commas).
    """
    spark = keyed.sparkSession
    dealt = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = shared.written(dealt.mapInArrow(_trees(run_keys), _NODES), "trie")
    columns = found.columns[:8]
    # neighbours over a border of partitions: one row per partition that holds keys
    ends = found.filter("key IS NOT NULL").select("part", "key", "words", "is_last")
    order = ends.filter("is_last").select("part").withColumn("after", F.lead("part").over(Window.orderBy("part")))
    pairs = ends.filter("is_last").select("part", F.col("key").alias("last_key")).join(order, "part") \
        .join(ends.filter("NOT is_last").select(F.col("part").alias("after"), "key", "words"), "after")
    edges = found.filter("edge AND key IS NULL").unionByName(pairs.select("last_key", "key", "words").mapInArrow(_between, _NODES))
    merged = edges.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent").alias("parent"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    hashed = found.filter("ends IS NOT NULL").select("node", "part", "run", "ends").repartition("node") \
        .sortWithinPartitions("node", "part", "run").mapInArrow(_hashed, "node binary, ends_sha256 string")
    merged = shared.written(merged.join(hashed, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE))), "edges")
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("up")) \
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    inner = found.filter("NOT edge").select(*columns, "parent")
    rows = inner.unionByName(merged.select(*[F.lit(None).cast("long").alias(c) if c == "parent_conv_id" else F.col(c) for c in columns], "parent"))
    direct = rows.filter("parent IS NULL")
    joined = rows.filter("parent IS NOT NULL").withColumn("copy", F.pmod(F.col("conv_id"), F.lit(COPIES)).cast("int")) \
        .join(above, ["parent", "copy"]).withColumn("parent_conv_id", F.col("up"))
    return direct.select(*columns).unionByName(joined.select(*columns))
