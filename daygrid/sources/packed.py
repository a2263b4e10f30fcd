"""Packed integers: value = stored integer x step, one reserved integer for a gap."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.expr import half_even

Packing = Mapping[str, tuple[float, bool]]


def _limits(unsigned: bool) -> tuple[int, int, int]:
    """fill, lowest and highest storable integer."""
    if unsigned:
        return config.UINT16_FILL, 0, config.UINT16_FILL - 1
    return config.INT16_FILL, config.INT16_FILL + 1, 32767


def packed(name: str, packing: Packing = config.PACKING, inside: Column | None = None) -> Column:
    step, unsigned = packing[name]
    fill, low, high = _limits(unsigned)
    value = half_even(F.col(name) / step, 0)
    refuse = F.raise_error(F.concat(F.lit(f"{name} does not fit its packed type: "), F.col(name).cast("string")))
    out = F.when(value.isNull(), F.lit(fill)).when(value.between(low, high), value.cast("int")).otherwise(
        refuse.cast("int"))
    return out if inside is None else F.when(inside, out).otherwise(F.lit(fill))


def unpacked(name: str, packing: Packing = config.PACKING) -> Column:
    step, unsigned = packing[name]
    fill, _, _ = _limits(unsigned)
    return F.when(F.col(name) != fill, half_even(F.col(name) * step, 2))


def pack(df: DataFrame, packing: Packing = config.PACKING, inside: Column | None = None) -> DataFrame:
    return df.withColumns({n: packed(n, packing, inside) for n in packing if n in df.columns})


def unpack(df: DataFrame, packing: Packing = config.PACKING) -> DataFrame:
    return df.withColumns({n: unpacked(n, packing) for n in packing if n in df.columns})
