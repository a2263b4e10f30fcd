"""Cells in polygons, by the parity of ring crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_region(cells: DataFrame, ring_edges: DataFrame, key: str = "cell_id", lat: str = "lat", lon: str = "lon"
              ) -> DataFrame:
    """(cell, region) of the cells inside: a ray to the east crosses the ring an odd number of times.

    An edge only meets the cells of the latitude bands it spans: both sides are
    bucketed by tenth of a degree, so the join is an equi join whose crossings
    are counted on the map side before the shuffle.
    """
    band = 10
    bands = F.explode(F.sequence(F.floor(F.least("y1", "y2") * band), F.floor(F.greatest("y1", "y2") * band))).alias("_band")
    e = ring_edges.select("region", "x1", "y1", "x2", "y2", bands)
    c = cells.select(key, F.col(lat).alias("_y"), F.col(lon).alias("_x"), F.floor(F.col(lat) * band).alias("_band"))
    spans = (F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))
    cross = F.col("x1") + (F.col("_y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (
        F.col("x2") - F.col("x1"))
    hits = c.join(e, "_band").filter(spans & (F.col("_x") < cross))
    return hits.groupBy(key, "region").agg(F.count("*").alias("_n")).filter("_n % 2 = 1").select(key, "region")
