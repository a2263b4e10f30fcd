"""Quality by a generalised additive model with pairwise interactions.

Every feature is cut to bins. Boosting goes round the features in a fixed order; each turn fits a shallow tree to the
residuals of one feature and adds it, scaled down, to that feature's table of bins. Then the pairs of features whose joint
residuals explain most get tables of two dimensions, boosted the same way. A score is the sum of the table entries that a
text's bins select, through the logistic function: for a batch of texts, one look-up and addition per table.

Features come from the whole text. The model is fitted on a bounded sample of labelled rows (``SAMPLE``, taken in the
order of a hash); all texts are scored. A null or empty text has all features zero and is scored like any other. If no
label of both kinds is there, every score is the share of label 1 (0.5 without labels). Labels that are null are not
learned from; of several labels of a document the lowest counts. Repeated rows stay, extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm import shared

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, PAIR_LEAVES, LEAST = 120, 60, 0.1, 4, 4, 12
FEATURES = ("chars", "words", "word_length", "small", "capital", "digit", "white", "stop", "sign", "bang", "bar", "accented", "line_length",
            "short_lines", "repeated_lines", "distinct_words", "top_word", "same_next", "repeated_threes", "signed_words", "capital_words")
SIGNS, STOPS = b"#*$%&|<>@+/=_~^{}[]`\\", b".,;:!?'\"()-"


def features(column) -> np.ndarray:
    """A row of numbers for each text of an Arrow column."""
    data, offsets = shared.text_bytes(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    kind = np.zeros(256, np.uint8)
    for k, values in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\n\v\f\r", STOPS, SIGNS, range(128, 256)), 1):
        kind[list(values)] = k
    for a, b in shared.slices(offsets):
        piece, rows = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        n = b - a
        size = np.diff(rows)
        counts = np.bincount(np.repeat(np.arange(n) * 8, size) + kind[piece], minlength=8 * n).reshape(n, 8)
        per = np.maximum(size, 1)

        def share(mask, rows=rows, per=per):
            held = np.r_[0, np.cumsum(mask)]
            return np.diff(held[rows]) / per

        white = (piece == 32) | ((piece >= 9) & (piece <= 13))
        inside = np.r_[False, ~white, False]
        edge = np.zeros(len(piece) + 1, bool)
        edge[rows] = True
        starts = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
        ends = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
        bounds = np.searchsorted(starts, rows)
        held = np.diff(bounds)
        row = np.repeat(np.arange(n), held)
        words = np.maximum(held, 1)
        low = np.where((piece >= 65) & (piece <= 90), piece + np.uint8(32), piece)
        h = shared.spans_hashed(low, starts, ends)
        distinct, top = _distinct(row, h, n)
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        threes = (row[2:] == row[:-2]) if len(h) > 2 else np.zeros(0, bool)
        three = shared.mixed(shared.mixed(h[:-2]) + shared.mixed(shared.mixed(h[1:-1])) + h[2:])[threes] if len(h) > 2 else h[:0]
        unlike, _ = _distinct(row[2:][threes] if len(h) > 2 else row[:0], three, n)
        signed, capital = (np.r_[0, np.cumsum(kind[piece] == k)] for k in (6, 2))
        holds = np.bincount(row, (signed[ends] > signed[starts]), minlength=n)
        shouts = np.bincount(row, (capital[ends] - capital[starts] >= 2), minlength=n)
        line_edge = np.unique(np.r_[rows, np.flatnonzero(piece == 10) + 1])
        line_start, line_end = line_edge[:-1], line_edge[1:]
        line_row = np.searchsorted(rows, line_start, side="right") - 1
        lines = np.maximum(np.bincount(line_row, minlength=n)[:n], 1) if len(line_row) else np.ones(n)
        line_hash = shared.spans_hashed(piece, line_start, line_end)
        unlike_lines, _ = _distinct(line_row, line_hash, n)
        short = np.bincount(line_row, line_end - line_start < 30, minlength=n)[:n] if len(line_row) else np.zeros(n)
        out[a:b] = np.stack([
            np.log1p(size), np.log1p(held), counts[:, [1, 2, 3, 5, 6, 7, 0]].sum(1) / words, *(counts[:, k] / per for k in range(1, 7)),
            share(piece == 33), share(piece == 124), counts[:, 7] / per, np.log1p(size / lines), short / lines, 1 - unlike_lines / lines,
            distinct / words, top / words, np.bincount(row[1:][same], minlength=n) / words,
            1 - unlike / np.maximum(np.bincount(row[2:][threes], minlength=n) if len(h) > 2 else np.zeros(n), 1), holds / words, shouts / words], 1)
        out[a:b][size == 0] = 0
    return out


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, how many different hashes it has and how often the most frequent one comes."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, np.int64)
    run = np.diff(np.r_[first, len(row)])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row[first], run)
    return np.bincount(row[first], minlength=n)[:n], top


@dataclass
class Model:
    """Bin edges and tables; all of fixed size."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, w: np.ndarray, leaves: int) -> np.ndarray:
    """Best-first splits of a line of bins; the value of each bin's leaf (a Newton step)."""
    parts = [(0, len(g))]
    sums_g, sums_w = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(w)]

    def worth(a, b):
        return (sums_g[b] - sums_g[a]) ** 2 / (sums_w[b] - sums_w[a] + 1.0)

    while len(parts) < leaves:
        best = max(((worth(a, c) + worth(c, b) - worth(a, b), a, c, b) for a, b in parts for c in range(a + 1, b)
                    if min(sums_w[c] - sums_w[a], sums_w[b] - sums_w[c]) >= LEAST * 0.05), default=(0.0,))
        if best[0] <= 1e-9:
            break
        _, a, c, b = best
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (sums_g[b] - sums_g[a]) / (sums_w[b] - sums_w[a] + 1.0)
    return out


def _grid_tree(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One cut along a side, then one cut of each half along the other: four leaves on a grid of bins."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, ww = (g.T, w.T) if flip else (g, w)
        up_g, up_w = np.cumsum(gg, 0), np.cumsum(ww, 0)
        for c in range(1, gg.shape[0]):
            value, laid = 0.0, np.zeros_like(gg)
            for part, a, b in ((slice(0, c), up_g[c - 1], up_w[c - 1]), (slice(c, None), up_g[-1] - up_g[c - 1], up_w[-1] - up_w[c - 1])):
                left_g, left_w = np.cumsum(a)[:-1], np.cumsum(b)[:-1]
                gain = left_g**2 / (left_w + 1) + (a.sum() - left_g) ** 2 / (b.sum() - left_w + 1)
                k = int(gain.argmax())
                value += gain[k]
                laid[part, :k + 1] = left_g[k] / (left_w[k] + 1)
                laid[part, k + 1:] = (a.sum() - left_g[k]) / (b.sum() - left_w[k] + 1)
            if value > best:
                best, out = value, laid.T.copy() if flip else laid
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < share < 1:  # smoothed, as nothing tells the kinds apart
        return Model(base=float(np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1))))
    model = Model(base=float(np.log(share / (1 - share))))
    d = x.shape[1]
    model.edges = [_cuts(x[:, j], BINS) for j in range(d)]
    model.coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    at = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(x), model.base)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, w = residual()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(at[j], g, n), np.bincount(at[j], w, n), LEAVES)
            model.tables[j] += step
            total += step[at[j]]
    near = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in range(d)]
    wide = [len(c) + 1 for c in model.coarse]

    def grid(i, j, values):
        return np.bincount(near[i] * wide[j] + near[j], values, wide[i] * wide[j]).reshape(wide[i], wide[j])

    g, w = residual()
    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            if wide[i] > 1 and wide[j] > 1:
                a, b = grid(i, j, g), grid(i, j, w)
                laid = _grid_tree(a, b)
                gains.append((float((laid * a - 0.5 * laid**2 * b).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, key=lambda t: (-t[0], t[1:]))[:PAIRS]]
    model.grids = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, w = residual()
            step = RATE * _grid_tree(grid(i, j, g), grid(i, j, w))
            model.grids[k] += step
            total += step[near[i], near[j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, taken in the order of a hash of their ids.

    The sampled labels are few by that bound and go to all executors; the documents are not shuffled.
    """
    taken = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken.select(F.col("doc_id").alias("of"), "quality")), F.col("doc_id") == F.col("of"))

    def measured(batches):
        import pyarrow as pa

        for batch in batches:
            x = features(batch.column("text"))
            shared.give_back()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()),
                                              pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # one row per document, in one order whatever the partitions were
    found = rows.select("doc_id", "quality", "text").mapInArrow(measured, "doc_id long, quality int, x array<double>") \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).toArrow()
    x = found.column("x").combine_chunks()
    x = np.asarray(x.flatten()).reshape(len(found), -1) if len(found) else np.zeros((0, len(FEATURES)))
    return fit(x, (found.column("quality").to_numpy() == 1).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            scores = model.scores(features(batch.column("text")))
            shared.give_back()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")


def kept(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``least``."""
    def passed(batches):
        import pyarrow as pa

        for batch in batches:
            passes = pa.array(model.scores(features(batch.column("text"))) >= least)
            shared.give_back()
            yield batch.filter(passes)

    return docs.mapInArrow(passed, docs.schema)
