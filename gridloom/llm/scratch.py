"""Tables in the folder that all executors share, bounded Arrow batches and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import new_path, shared_dir, staged

__all__ = ["new_path", "shared_dir", "small_batches", "smallest", "staged"]
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes, as texts may be long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not (now.rstrip("bB").isdigit() and 0 < int(now.rstrip("bB")) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def smallest(df: DataFrame, hashed: Column, ties: list[str], n: int) -> DataFrame:
    """About the ``n`` rows with the smallest hashes, ``n`` at most, for a sample whose size is a parameter.

    A hash below a bound that about twice ``n`` rows pass is asked for first,
    so that partitions don't send ``n`` rows each to the driver.
    """
    rows = df.count()
    if rows > 2 * n:
        df = df.where(hashed < F.lit(int(-(1 << 63) + (1 << 64) * (2 * n / rows))).cast("long"))
    return df.orderBy(hashed, *ties).limit(n)
