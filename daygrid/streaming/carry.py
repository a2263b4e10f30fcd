"""Snow stock and soil reservoir carried from day to day as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from daygrid import config
from daygrid.functions.calendar import snow_year

OUTPUT = "source STRING, cell_id BIGINT, day DATE, snow_stock DOUBLE, water DOUBLE, fill DOUBLE, drainage DOUBLE, late BOOLEAN"
STATE = "stock DOUBLE, depletion DOUBLE, last_day INT, snow_year INT, held BINARY"
FIGURES = ("snow_stock", "water", "fill", "drainage")
COLUMNS = ["ordinal", "snow_year", "tas", "pr", "et0", "capacity"]


def _advance(days: np.ndarray, stock: float, depletion: float, last: int, winter: int) -> tuple[tuple[list, ...], tuple]:
    """Days (rows of ``COLUMNS``) after ``last`` in order; an older or repeated day changes nothing and is told as late, without figures."""
    out = ordinals, stocks, waters, fills, drainages, late = [], [], [], [], [], []
    half, nan = config.SOIL_DEPLETION_FRACTION, float("nan")
    for ordinal, year, tas, pr, et0, cap in zip(*days.T.tolist()):
        ordinals.append(int(ordinal))
        if ordinal <= last:
            for figures in (stocks, waters, fills, drainages):
                figures.append(nan)
            late.append(True)
            continue
        last = int(ordinal)
        if year != winter:
            stock, winter = 0.0, int(year)
        rain = 0.0 if pr != pr else pr
        water = rain
        if tas == tas:
            fall = rain if tas < config.SNOW_FALL_C else 0.0
            melt = min(stock + fall, config.SNOW_MELT_MM * max(tas, 0.0))
            stock = stock + fall - melt
            water = rain - fall + melt
        fill = drainage = nan
        if et0 == et0:
            stress = 1.0 if depletion <= half * cap else (cap - depletion) / (cap - half * cap)
            after = depletion + stress * et0 - water
            drainage = max(-after, 0.0)
            depletion = min(max(after, 0.0), cap)
            fill = 1.0 - depletion / cap
        stocks.append(stock)
        waters.append(water)
        fills.append(fill)
        drainages.append(drainage)
        late.append(False)
    return out, (float(stock), float(depletion), last, winter)


def carried(days: DataFrame, hold_days: int = 0) -> DataFrame:
    """Stock, water, fill and drainage of each new day (``days``: source, cell_id, day, tas, pr, et0, capacity).

    The state of a cell is three numbers and its held days. Days of a micro-batch are put in order; a day waits in the
    state until the newest day of its cell is ``hold_days`` past it, so days may come out of order by less than that. A
    row without a day ends the wait of its cell. What comes later still, or again, gives a row that is ``late`` and has
    no figures: filter and count these, they are missing from the days after them.
    """
    ready = days.select(
        "source", "cell_id", F.unix_date("day").cast("double").alias("ordinal"),
        snow_year("day").cast("double").alias("snow_year"), *[F.col(n).cast("double").alias(n) for n in COLUMNS[2:]])

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, waiting = state.get if state.exists else (0.0, 0.0, -(10**6), 0, b"")
        before = np.frombuffer(bytes(waiting)).reshape(-1, len(COLUMNS))
        came = np.concatenate([before, *[np.column_stack([b[c].to_numpy(float) for c in COLUMNS]) for b in batches]])
        ends = np.isnan(came[:, 0])
        known = came[~ends]
        known = known[np.argsort(known[:, 0], kind="stable")]
        open_after = np.inf if ends.any() else max(known[:, 0].max(), held[2]) - hold_days
        closed = known[:, 0] <= max(open_after, held[2])
        (ordinals, *figures, late), held = _advance(known[closed], *held)
        state.update((*held, known[~closed].tobytes()))
        if ordinals:
            dates = np.array(ordinals, "datetime64[D]").astype(object)
            yield pd.DataFrame({"source": key[0], "cell_id": key[1], "day": dates, **dict(zip(FIGURES, figures)), "late": late})

    return ready.groupBy("source", "cell_id").applyInPandasWithState(
        step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
