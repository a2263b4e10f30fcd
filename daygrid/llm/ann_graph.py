"""Approximate nearest neighbours by cosine: robust-pruned graphs, one per shard, searched by beams.

Vectors are put together by equal content first: a vector that many rows share is one node, and of its rows only the few
of smallest id that an answer can hold are kept, summed up before they move. Nodes are dealt to shards by a hash. In a
shard a directed graph grows batch by batch: a greedy beam search proposes neighbours, pruning keeps an edge only if no
kept neighbour is nearer to its end by the factor ``ALPHA``, edges back are added and pruned the same way. The index is a
table (one row per node). Queries, once per distinct vector, go to every shard; a task holds one shard and streams the
queries through it. What the beams find is scored on the original vectors in double precision and merged.

Vectors that are null, zero, or hold a null or a non-finite number take no part, nor do rows without an id; equal rows
count once. Vectors are searched among those of their own length. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.llm import shared

SHARD = 8192  # nodes
DEGREE, SLACK = 28, 42  # edges after pruning, edges at most before it
ALPHA = 1.2
BUILD_BEAM, SEARCH_BEAM, WIDTH = 56, 96, 4
BATCH = 512
INDEX = "shard long, node int, members array<long>, vector array<float>, edges array<int>"


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<float>").alias("vector")) \
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()) \
        .filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)).filter(~bad)


def nodes(vectors: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: its ``keep`` smallest ids, ascending. Ids beyond are cut before the shuffle."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = vectors.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def beam(vectors, edges, entries, queries, width):
    """Ids and similarities of the ``width`` best nodes found for each query, best first; -1 where there are fewer."""
    b, n = len(queries), len(vectors)
    ids = np.full((b, width), -1, np.int64)
    near = np.full((b, width), -np.inf, np.float32)
    done = np.ones((b, width), bool)
    seen = np.zeros((b, n), bool)
    rows, found = np.repeat(np.arange(b), len(entries)), np.tile(entries, b)
    while True:
        flat = np.unique(rows * n + found)
        flat = flat[~seen.reshape(-1)[flat]]
        if len(flat):
            seen.reshape(-1)[flat] = True
            row, node = np.divmod(flat, n)
            close = np.einsum("ij,ij->i", vectors[node], queries[row])
            start = np.searchsorted(row, np.arange(b + 1))
            most = int(np.diff(start).max())
            new_ids, new_near = np.full((b, most), -1, np.int64), np.full((b, most), -np.inf, np.float32)
            place = np.arange(len(row)) - start[row]
            new_ids[row, place], new_near[row, place] = node, close
            all_ids, all_near = np.concatenate([ids, new_ids], 1), np.concatenate([near, new_near], 1)
            all_done = np.concatenate([done, new_ids < 0], 1)
            best = np.argsort(-all_near, 1, kind="stable")[:, :width]
            ids, near, done = (np.take_along_axis(a, best, 1) for a in (all_ids, all_near, all_done))
        # the first few nodes of each beam that were not expanded yet
        rank = np.cumsum(~done, 1)
        take = ~done & (rank <= WIDTH)
        if not take.any():
            return ids, near
        rows, column = np.nonzero(take)
        nodes_now = ids[rows, column]
        done |= take
        found = edges[nodes_now]
        rows = np.repeat(rows, found.shape[1])
        found = found.reshape(-1)
        rows, found = rows[found >= 0], found[found >= 0]


def pruned(vectors, points, candidates, degree):
    """Diverse edges of ``points`` out of their candidates (padded with -1)."""
    p, c = candidates.shape
    out = np.full((p, degree), -1, np.int32)
    order = np.sort(candidates, 1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    order[order == points[:, None]] = -1
    at = vectors[np.maximum(order, 0)]
    far = np.where(order >= 0, 2 - 2 * np.einsum("pcd,pd->pc", at, vectors[points]), np.inf)
    for k in range(degree):
        pick = far.argmin(1)
        live = np.isfinite(far[np.arange(p), pick])
        if not live.any():
            break
        out[live, k] = order[np.arange(p), pick][live]
        between = 2 - 2 * np.einsum("pcd,pd->pc", at, at[np.arange(p), pick])
        far[(ALPHA * between <= far) & live[:, None]] = np.inf
        far[np.arange(p), pick] = np.inf
    return out


def graph(vectors: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entry nodes) of unit vectors."""
    n = len(vectors)
    edges = np.full((n, SLACK), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    middle = vectors.mean(0)
    first = int((vectors @ middle).argmax())
    order = np.r_[first, order[order != first]]
    entries, at = np.array([first]), 1
    while at < n:
        batch = order[at:at + min(BATCH, at)]
        at += len(batch)
        found, _ = beam(vectors, edges, entries, vectors[batch], BUILD_BEAM)
        out = pruned(vectors, batch, found, DEGREE)
        edges[batch, :DEGREE] = out
        tail, head = np.repeat(batch, DEGREE), out.reshape(-1)
        tail, head = tail[head >= 0], head[head >= 0]
        by = np.argsort(head, kind="stable")
        tail, head = tail[by], head[by]
        targets, start, count = np.unique(head, return_index=True, return_counts=True)
        more = np.full((len(targets), int(count.max())), -1, np.int32)
        more[np.repeat(np.arange(len(targets)), count), np.arange(len(head)) - np.repeat(start, count)] = tail
        both = np.concatenate([edges[targets], more], 1)
        both = -np.sort(-both, 1)  # padding last
        full = (both >= 0).sum(1) > SLACK
        edges[targets[~full]] = both[~full, :SLACK]
        for a in range(0, int(full.sum()), BATCH):
            some = np.flatnonzero(full)[a:a + BATCH]
            edges[targets[some]] = -1
            edges[targets[some], :DEGREE] = pruned(vectors, targets[some], both[some], DEGREE)
    more = np.random.default_rng(seed).permutation(n)[:8]
    return edges, np.unique(np.r_[first, more])


def build(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """The index of ``rows`` (vector, members): written to the shared folder, one row per node with its edges.

    The entry nodes of a shard have the numbers from 0 on, so that they need no table of their own.
    """
    rows = shared.written(rows, "nodes")
    shards = max(1, -(-rows.count() // shard))
    size = F.size("vector")
    dealt = rows.withColumn("shard", size.cast("long") * (1 << 32) + F.pmod(F.xxhash64(F.col("members")[0]), F.lit(shards)))

    def grow(key, table):
        import pyarrow as pa

        order = np.argsort(np.array([m[0] for m in table.column("members").to_pylist()]), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        original = np.asarray(table.column("vector").combine_chunks().flatten()).reshape(len(table), -1)
        edges, entries = graph(_unit(original))
        to = np.r_[entries, np.setdiff1d(np.arange(len(table)), entries)]  # entries first
        number = np.empty(len(table), np.int32)
        number[to] = np.arange(len(table))
        kept = [[-len(entries), *number[e[e >= 0]].tolist()] if k == 0 else number[e[e >= 0]].tolist() for k, e in enumerate(edges[to])]
        table = table.take(pa.array(to))
        return pa.table([pa.array(np.full(len(table), key[0].as_py())), pa.array(np.arange(len(table), dtype=np.int32)), table.column("members"),
                         table.column("vector"), pa.array(kept, pa.list_(pa.int32()))], ["shard", "node", "members", "vector", "edges"])

    return shared.written(dealt.select("shard", "members", "vector").groupBy("shard").applyInArrow(grow, INDEX), "index")


def search(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_BEAM) -> DataFrame:
    """(query, vec_id, score): for each of ``queries`` (query, vector) the ``k`` best rows found in all shards."""
    shards = index.select("shard").distinct()
    asked = queries.select("query", "vector", F.size("vector").cast("long").alias("of")) \
        .join(shards, F.col("of") == F.floor(F.col("shard") / (1 << 32))) \
        .select("shard", F.lit(1).alias("kind"), F.col("query").alias("id"), F.lit(None).cast("array<long>").alias("members"), "vector",
                F.lit(None).cast("array<int>").alias("edges"))
    held = index.select("shard", F.lit(0).alias("kind"), F.col("node").cast("long").alias("id"), "members", "vector", "edges")
    rows = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "id")

    def stream(batches):
        import pyarrow as pa

        now, waiting, ready = None, [], None

        def answers(table):
            """Best rows of one shard for a block of queries."""
            original, members, unit, edges, entries = ready
            asked_vectors = np.asarray(table.column("vector").combine_chunks().flatten()).reshape(len(table), -1)
            names = table.column("id").to_pylist()
            for a in range(0, len(table), BATCH):
                block = asked_vectors[a:a + BATCH]
                found, _ = beam(unit, edges, entries, _unit(block), max(width, k))
                out = []
                for name, vector, ids in zip(names[a:a + BATCH], block.astype(np.float64), found, strict=True):
                    ids = ids[ids >= 0]
                    near = original[ids].astype(np.float64)
                    scores = (near * vector).sum(1) / (np.sqrt((near * near).sum(1)) * np.sqrt((vector * vector).sum()))
                    best = sorted((-s, m) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) for m in members[i])[:k]
                    out += [(name, m, -s) for s, m in best]
                q, m, s = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.float64())], ["query", "vec_id", "score"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            shard, kind = table.column("shard").to_numpy(), table.column("kind").to_numpy()
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(table)], strict=True):
                if a == b:
                    continue
                part = table.slice(a, b - a)
                if kind[a] == 0:
                    if shard[a] != now:
                        now, waiting, ready = shard[a], [], None
                    waiting.append(part)
                    continue
                if shard[a] != now:
                    continue  # queries of a shard without nodes
                if ready is None:
                    held_rows = pa.concat_tables(waiting).combine_chunks()
                    waiting = []
                    original = np.asarray(held_rows.column("vector").combine_chunks().flatten()).reshape(len(held_rows), -1)
                    lists = held_rows.column("edges").to_pylist()
                    entries, lists[0] = np.arange(-lists[0][0]), lists[0][1:]
                    edges = np.full((len(lists), max(1, max(map(len, lists)))), -1, np.int32)
                    for row, one in enumerate(lists):
                        edges[row, :len(one)] = one
                    ready = original, held_rows.column("members").to_pylist(), _unit(original), edges, entries
                yield from answers(part)

    found = rows.mapInArrow(stream, "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def nearest(df: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of every row that satisfies ``is_query``."""
    vectors = usable(df, vec_id, vector)
    index = build(nodes(vectors, k + 1))
    asking = vectors.filter(is_query).distinct()
    named = asking.join(index.select(F.col("vector").alias("v"), F.col("members")[0].alias("query")), F.col("vector") == F.col("v")) \
        .select("vec_id", "query", "vector")
    asked = shared.written(named, "queries")
    found = search(index, asked.groupBy("query").agg(F.first("vector").alias("vector")), k + 1)
    own = asked.select(F.col("vec_id").alias("query_id"), "query").join(found, "query").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
