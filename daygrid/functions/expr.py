"""Small column expressions: gaps, guarded clips, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int | str


def col(value: Value) -> Column:
    """A column from a name, a number or a column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def gap(value: Value) -> Column:
    """NaN becomes NULL: a gap is always NULL downstream."""
    c = col(value)
    return F.when(~F.isnan(c), c)


def known(*values: Value) -> Column:
    """True where every value is present."""
    out = None
    for v in values:
        here = col(v).isNotNull()
        out = here if out is None else out & here
    return out


def clip(value: Value, low: Value | None = None, high: Value | None = None) -> Column:
    """Clip that keeps a gap a gap (``least`` and ``greatest`` skip NULL)."""
    c = col(value)
    out = c
    if low is not None:
        out = F.greatest(out, col(low).cast("double"))
    if high is not None:
        out = F.least(out, col(high).cast("double"))
    return F.when(c.isNotNull(), out)


def at_most(value: Value, high: Value) -> Column:
    return clip(value, None, high)


def at_least(value: Value, low: Value) -> Column:
    return clip(value, low, None)


def half_even(value: Value, digits: int = 0) -> Column:
    """Round half to even on the binary value, as array libraries do: scale, rint, scale back."""
    if digits == 0:
        return F.rint(col(value))
    scale = float(10**digits)
    return F.rint(col(value) * scale) / scale


def half_even_of(total: Value, parts: Value) -> Column:
    """``total / parts`` of two whole numbers (``parts`` over 0), rounded half to even without leaving whole numbers."""
    top, parts = col(total).cast("long"), col(parts).cast("long")
    rest = F.pmod(top, parts)
    below = F.call_function("div", top - rest, parts)
    up = (2 * rest > parts) | ((2 * rest == parts) & (F.pmod(below, F.lit(2)) == 1))
    return below + F.when(up, 1).otherwise(0)


def ratio(top: Value, bottom: Value) -> Column:
    """Division where a zero divisor gives NULL."""
    b = col(bottom)
    return col(top) / F.when(b != 0, b)


def month_table(values: tuple[float, ...], month: Column) -> Column:
    """The value of a 12-entry table at a month (1-12)."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), month.cast("int"))


def steps(value: Value, edges: tuple[float, ...]) -> Column:
    """How many edges are at or under the value; NULL for a gap."""
    c = col(value)
    total = F.lit(0)
    for edge in edges:
        total = total + F.when(c >= F.lit(edge), 1).otherwise(0)
    return F.when(c.isNotNull(), total)
