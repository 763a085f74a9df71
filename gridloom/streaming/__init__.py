"""Rasters that fold in cells as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(stream: DataFrame, j: Column, i: Column, value: Column, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Running (j, i, v, n, low, high) of a stream of rows; with ``time``, state is dropped ``late`` after it.

    Sums are kept as decimals, so the order of arrival doesn't show.
    """
    rows = stream.withWatermark(time, late) if time else stream
    keys = [F.window(time, late)] if time else []
    return rows.groupBy(*keys, j.cast("int").alias("j"), i.cast("int").alias("i")).agg(F.sum(value.cast("decimal(18,2)")).cast("double").alias("v"), F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
