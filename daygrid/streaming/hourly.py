"""Hourly rows to UTC days as a stream: the batch reduction under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.operators.hourly import STATISTICS, Spec


def daily_stream(hourly: DataFrame, spec: Spec, keys: tuple[str, ...] = ("cell_id",), ts: str = "ts", delay: str = "2 hours"
                 ) -> DataFrame:
    """One row per key and UTC day, out once the watermark has passed the end of the day (append mode).

    Only the statistics of open days are kept as state. Values stamped at the
    end of their hour count an hour earlier, as in the batch form: a row that
    falls in two days is sent to both.
    """
    own = F.col(ts).cast("timestamp")
    before = own - F.expr("INTERVAL 1 HOUR")
    stamps = {end for _, _, end in spec.values()}
    if stamps == {False}:
        at = hourly.withColumns({"_at": own, "_use": F.lit("both")})
    elif stamps == {True}:
        at = hourly.withColumns({"_at": before, "_use": F.lit("both")})
    else:
        targets = F.when(F.to_date(own) == F.to_date(before), F.array(F.struct(own.alias("t"), F.lit("both").alias("u")))).otherwise(
            F.array(F.struct(own.alias("t"), F.lit("start").alias("u")), F.struct(before.alias("t"), F.lit("end").alias("u"))))
        at = hourly.withColumn("_x", F.explode(targets)).withColumns({"_at": F.col("_x.t"), "_use": F.col("_x.u")}).drop("_x")
    aggs = [STATISTICS[s](F.when(F.col("_use").isin("both", "end" if end else "start"), F.col(field))).alias(name)
            for name, (field, s, end) in spec.items()]
    days = at.withWatermark("_at", delay).groupBy(*keys, F.window("_at", "1 day")).agg(*aggs)
    return days.select(*keys, F.to_date("window.start").alias("day"), *spec)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now into Parquet files, and read them back."""
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/rows")
             .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
