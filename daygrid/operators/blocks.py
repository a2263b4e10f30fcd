"""Sparse weights and neighbours over blocks of cells: days travel packed by cell and year, sums are taken on matrices.

A batch of daily rows is packed before any shuffle to one row per (source, cell, year). Packed rows go, once, to the
blocks that need them: their own, and the next ones for cells near an edge. A block's weights or pairs come first and serve
every year that follows. One task holds those and one year of the block's cells, whatever the length of the series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Targets of one block, by ascending id; ids of a grid run along its rows, so a block is a strip of it.
BLOCK = 1024
#: Side of a square block of cells that meet their neighbours.
TILE = 64
#: Years of a block are dealt to so many tasks, each with a copy of its weights.
SALTS = 16


def packed(daily: DataFrame, names: Sequence[str]) -> DataFrame:
    """source, cell_id, year, days (day of year from 0) and one list per name; a batch gives a row per cell and year in it."""
    lists = ", ".join(f"v{k} array<double>" for k in range(len(names)))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            day = batch.column("day").cast(pa.int32()).to_numpy(zero_copy_only=False)
            cell = batch.column("cell_id").to_numpy(zero_copy_only=False)
            source = batch.column("source").dictionary_encode()
            code = source.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            whole = day.astype("datetime64[D]")
            year = whole.astype("datetime64[Y]")
            order = np.lexsort((year, cell, code))
            y, c, s = year[order], cell[order], code[order]
            first = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
            offsets = pa.array(np.r_[first, len(order)].astype(np.int32))
            nth = (whole - year.astype("datetime64[D]")).astype(np.int16)[order]
            values = [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False)[order] for n in names]
            named = batch.column("source").take(pa.array(order[first]))
            yield pa.RecordBatch.from_arrays(
                [named, pa.array(c[first].astype(np.int64)), pa.array((y[first].astype(np.int64) + 1970).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(nth)),
                 *[pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]],
                ["source", "cell_id", "year", "days", *[f"v{k}" for k in range(len(names))]])

    return daily.filter("day IS NOT NULL AND cell_id IS NOT NULL").select("source", "cell_id", "day", *names).mapInArrow(
        pack, f"source string, cell_id long, year int, days array<smallint>, {lists}")


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _by_block(daily: DataFrame, names: Sequence[str], links: DataFrame, sides: Sequence[str], make, schema: str) -> DataFrame:
    """Rows that the tasks of the blocks make of packed years.

    ``links``: _block and other columns, of which ``sides`` name cells whose days the block needs. ``make`` takes arrays of
    the other columns and returns a function of (year, cells, days in each, days, values by name), called once per source and
    year; it gives a list of arrays in the order of ``schema`` after source, days counted in the year.
    """
    held = [c for c in links.columns if c != "_block"]
    flat, n = packed(daily, names), len(names)
    needed = None
    for side in sides:
        some = links.select(F.col(side).alias("cell_id"), "_block")
        needed = some if needed is None else needed.unionByName(some)
    sent = flat.join(needed.distinct(), "cell_id").withColumn("_salt", F.pmod("year", F.lit(SALTS)))
    columns, types = ["source", "cell_id", "year", "days", *[f"v{k}" for k in range(n)]], dict(flat.dtypes)
    lists = links.groupBy("_block").agg(F.collect_list(F.struct(*held)).alias("_l")).select(
        "_block", *[F.col(f"_l.{c}").alias(f"_{c}") for c in held], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    head = lists.select("_block", "_salt", *[f"_{c}" for c in held], *[F.lit(None).cast(types[c]).alias(c) for c in columns])
    body = sent.select("_block", "_salt", *[F.lit(None).cast(t).alias(c) for c, t in lists.dtypes if c not in ("_block", "_salt")], *columns)
    first = f"_{held[0]}"
    dealt = head.unionByName(body).repartition("_block", "_salt").sortWithinPartitions("_block", "_salt", F.col(first).isNull(), "source", "year")
    out = [c.split()[0].strip("`") for c in schema.split(", ")]

    def work(batches):
        import pyarrow as pa

        year_of, key, parts = None, None, []

        def done():
            if not parts:
                return
            cell, lengths, days, *values = (np.concatenate(c) for c in zip(*parts))
            made = year_of(key[1], cell, lengths, days, values)
            start = np.datetime64(f"{key[1]:04d}-01-01", "D").astype(int)
            arrays = [pa.array((v + start).astype(np.int32)).cast(pa.date32()) if c == "day" else pa.array(v) for c, v in zip(out[1:], made)]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()).take(pa.array(np.zeros(len(made[0]), np.int32))), *arrays], out)

        for batch in batches:
            heads = batch.column(first).is_valid().to_numpy(zero_copy_only=False)
            source, year = batch.column("source").to_pylist(), batch.column("year").to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                if heads[at]:
                    yield from done()
                    key, parts = None, []
                    year_of = make(*(np.asarray(batch.column(f"_{c}")[at].values) for c in held))
                    at += 1
                    continue
                end = at + 1
                while end < batch.num_rows and not heads[end] and (source[end], year[end]) == (source[at], year[at]):
                    end += 1
                if key != (source[at], int(year[at])):
                    yield from done()
                    key, parts = (source[at], int(year[at])), []
                rows = batch.slice(at, end - at)
                parts.append((rows.column("cell_id").to_numpy(zero_copy_only=False), rows.column("days").value_lengths().to_numpy(zero_copy_only=False),
                              _flat(rows.column("days")).astype(np.int64), *[_flat(rows.column(f"v{k}")) for k in range(n)]))
                at = end
        yield from done()

    return dealt.select(*[f"_{c}" for c in held], *columns).mapInArrow(work, schema)


def weighted_sums(daily: DataFrame, weights: DataFrame, names: Sequence[str]) -> DataFrame:
    """source, cell_to, day, and per name ``sum_<name>`` (weight times value) and ``weight_<name>`` (weights of known values).

    A row for every target and day on which one of its source cells has a row. ``weights``: cell_to, cell_from, w.
    Rows without a cell or day take no part; repeated rows count each time.
    """
    def make(to, source, weight):
        order = np.lexsort((source, to))
        targets, starts = np.unique(to[order], return_index=True)
        cells, at = np.unique(source[order], return_inverse=True)
        w = weight[order][:, None]

        def year(number, cell, lengths, days, values):
            flat = np.repeat(np.searchsorted(cells, cell), lengths) * 366 + days
            spread = lambda of: np.bincount(flat, weights=of, minlength=len(cells) * 366).reshape(len(cells), 366)[at]
            held = np.add.reduceat(spread(None), starts, axis=0) > 0
            target, day = np.nonzero(held)
            sums = []
            for v in values:
                known = ~np.isnan(v)
                sums += [np.add.reduceat(w * spread(of), starts, axis=0)[held] for of in (np.where(known, v, 0.0), known.astype(float))]
            return [targets[target], day, *sums]

        return year

    links = weights.select(F.col("cell_to").cast("long").alias("cell_to"), F.col("cell_from").cast("long").alias("cell_from"), F.col("w").cast("double").alias("w"))
    links = links.withColumn("_block", F.floor(F.col("cell_to") / BLOCK))
    columns = ", ".join(f"`{kind}_{n}` double" for n in names for kind in ("sum", "weight"))
    return _by_block(daily, names, links, ("cell_from",), make, f"source string, cell_to long, day date, {columns}")


def lagged(cells: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Pairs of a cell and the one k to the east or south: _block, cell_id, other_id, lag, way (0 east, 1 south)."""
    here = cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    moves = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.lit(way).alias("way")) for k in lags for way in (0, 1)])).alias("m")
    there = here.select(F.col("cell_id").alias("other_id"), F.col("row").alias("_r"), F.col("col").alias("_c"))
    block = F.xxhash64(F.floor(F.col("row") / TILE), F.floor(F.col("col") / TILE))
    asked = here.select("cell_id", block.alias("_block"), "row", "col", moves).select(
        "_block", "cell_id", "m.lag", "m.way", (F.col("row") + F.col("m.lag") * F.col("m.way")).alias("_r"), (F.col("col") + F.col("m.lag") * (1 - F.col("m.way"))).alias("_c"))
    return asked.join(there, ["_r", "_c"]).select("_block", "cell_id", "other_id", "lag", "way")


class _Year:
    """A year of a block as matrices of cells by days."""

    def __init__(self, cells, cell, lengths, days, value):
        at = np.searchsorted(cells, cell)
        flat, shape = np.repeat(at, lengths) * 366 + days, (len(cells), 366)
        self.value, self.held = np.full(shape, np.nan), np.zeros(shape, bool)
        self.value.reshape(-1)[flat], self.held.reshape(-1)[flat] = value, True


def neighbour_days(daily: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """source, cell_id, day, lag, way, value, other: days on which both cells of a pair have a row (one per cell and day)."""
    def make(cell_id, other_id, lag, way):
        cells, at = np.unique(np.r_[cell_id, other_id], return_inverse=True)
        here, there = np.split(at, 2)

        def year(number, cell, lengths, days, values):
            y = _Year(cells, cell, lengths, days, values[0])
            parts = []
            for k in range(0, len(here), 512):  # some pairs at a time
                a, b = here[k:k + 512], there[k:k + 512]
                pair, day = np.nonzero(y.held[a] & y.held[b])
                parts.append((cell_id[k + pair], day, lag[k + pair], way[k + pair], y.value[a[pair], day], y.value[b[pair], day]))
            return [np.concatenate(c) for c in zip(*parts)]

        return year

    out = _by_block(daily, [name], pairs, ("cell_id", "other_id"), make, "source string, cell_id long, day date, lag int, way int, value double, other double")
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("source", "cell_id", "day", "lag", F.when(F.col("way") == 0, "east").otherwise("south").alias("way"), known("value"), known("other"))


def neighbour_sums(daily: DataFrame, pairs: DataFrame, name: str, group_of_month: Sequence[int]) -> DataFrame:
    """Sums over the days on which both cells of a pair are known, per year and group of months.

    source, cell_id, lag, way (0 east, 1 south), part (the group), vo, vv, oo (sums of products).
    """
    groups = np.asarray(group_of_month)

    def make(cell_id, other_id, lag, way):
        cells, at = np.unique(np.r_[cell_id, other_id], return_inverse=True)
        here, there = np.split(at, 2)

        def year(number, cell, lengths, days, values):
            y = _Year(cells, cell, lengths, days, values[0])
            dates = np.datetime64(f"{number:04d}-01-01") + np.arange(366)  # the last column of a common year is empty
            group = groups[dates.astype("datetime64[M]").astype(int) % 12]
            parts = []
            for k in range(0, len(here), 512):
                a, b = y.value[here[k:k + 512]], y.value[there[k:k + 512]]
                both = ~(np.isnan(a) | np.isnan(b))
                a, b = np.where(both, a, 0.0), np.where(both, b, 0.0)
                for g in np.unique(groups):
                    days_in = group == g
                    pair = np.flatnonzero(both[:, days_in].any(1))
                    v, o = a[np.ix_(pair, days_in)], b[np.ix_(pair, days_in)]
                    parts.append((cell_id[k + pair], lag[k + pair], way[k + pair], np.full(len(pair), g), (v * o).sum(1), (v * v).sum(1), (o * o).sum(1)))
            return [np.concatenate(c) for c in zip(*parts)]

        return year

    return _by_block(daily, [name], pairs, ("cell_id", "other_id"), make, "source string, cell_id long, lag int, way int, part long, vo double, vv double, oo double")
