"""Exact quantiles at fixed levels, and how a value sits among them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.expr import Value, clip, col, half_even


def levels(n: int = config.LEVELS) -> list[float]:
    return [(i + 0.5) / n for i in range(n)]


def snapped(array: Value) -> Column:
    """Entries to nine decimals: interpolating between equal values must give that value,
    or ties with it would be missed for a last bit."""
    return F.transform(col(array), lambda v: half_even(v, 9))


def quantile_array(value: Value, n: int = config.LEVELS) -> Column:
    """Aggregate: the n quantiles of the known values, linear between ranks; NULL when none."""
    return snapped(F.percentile(col(value), F.array(*[F.lit(v) for v in levels(n)])))


def quantiles_of_sorted(values: Value, n: int = config.LEVELS) -> Column:
    """The same quantiles out of a sorted array; NULL for an empty one."""
    a = col(values)
    top = F.size(a) - 1

    def at(tau):
        pos = tau * top
        i = F.floor(pos).cast("int")
        part = pos - i
        return (1.0 - part) * F.get(a, i) + part * F.get(a, F.least(i + 1, top))

    return F.when(F.size(a) > 0, snapped(F.transform(F.array(*[F.lit(v) for v in levels(n)]), at)))


def rank_in(value: Value, q: Value) -> Column:
    """Fractional index of a value among sorted quantiles; equal quantiles give their middle."""
    x, q = col(value), col(q)
    n = F.size(q)
    counts = F.struct(F.size(F.filter(q, lambda v: v <= x)).alias("le"), F.size(F.filter(q, lambda v: v < x)).alias("lt"))

    def among(c):
        le, lt = c["le"], c["lt"]
        low = F.get(q, F.greatest(le - 1, F.lit(0)))
        high = F.get(q, F.least(le, n - 1))
        part = F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
        return F.when(le - lt > 1, (lt + le - 1) / 2.0).otherwise(le - 1 + part)

    # Named inside a function of one element, or each mention of a count would go through the quantiles again.
    at = F.get(F.transform(F.transform(F.array(counts), among), lambda a: clip(a, 0.0, n - 1)), F.lit(0))
    return F.when(x.isNotNull() & q.isNotNull(), at)


def read_at(table: Value, index: Value) -> Column:
    """A table read at a fractional index, linear between its entries."""
    t, f = col(table), col(index)
    i = F.floor(f).cast("int")
    part = f - i
    high = F.get(t, F.least(i + 1, F.size(t) - 1))
    return (1.0 - part) * F.get(t, i) + part * high
