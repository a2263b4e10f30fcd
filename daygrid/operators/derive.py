"""Fields rebuilt from corrected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.functions import humidity


def ordered_extremes(df: DataFrame, low: str = "tasmin", high: str = "tasmax") -> DataFrame:
    """Exchange the two where the lower is above the higher; a gap leaves both as they are."""
    crossed = F.col(low) > F.col(high)
    return df.withColumns({
        low: F.when(crossed, F.col(high)).otherwise(F.col(low)),
        high: F.when(crossed, F.col(low)).otherwise(F.col(high))})


def derived_fields(df: DataFrame) -> DataFrame:
    """Specific humidity from hurs, tas (K) and ps (Pa); reflected radiation from rsds and albedo."""
    return df.withColumns({
        "huss": humidity.specific_humidity("hurs", "tas", "ps"),
        "rsus": F.col("rsds") * F.col("alb")})
