"""Tables as rasters: one cell per pair of key values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import HEIGHT, Raster, blank
from ..plans.world import GridSpec, World


def rasterise_table(df: DataFrame, j: Column, i: Column, value: Column, spec: GridSpec, world: World, complete: bool = False, kind: str = HEIGHT) -> Raster:
    """Aggregated ``value`` per (j, i); cells that no row falls in are 0 unless ``complete`` says there are none."""
    cells = df.groupBy(j.cast("int").alias("j"), i.cast("int").alias("i")).agg(value.cast("double").alias("v"))
    if not complete:
        every = blank(df.sparkSession, spec, world).df
        cells = every.join(cells, ["j", "i"], "left").select("j", "i", F.coalesce("v", F.lit(0.0)).alias("v"))
    return Raster(cells, spec, world, kind)


CELL = 100.0


def line12(spark: SparkSession, sf_dir: str) -> Raster:
    """Rough ground from ``lineitem`` by month (rows) and quantity (columns), 12 x 50.

    A slope over both axes, and 0 to 400 m of relief from the last digits of
    the cell's summed price, so that heights spread alike at every scale.
    """
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")) * 100).cast("long") % 40000
    g = rasterise_table(t, F.month("l_shipdate") - 1, F.col("l_quantity") - 1, cents, GridSpec(50, 12, (49 * CELL, 11 * CELL)), World((49 * CELL, 11 * CELL), (0.0, 2000.0)), complete=True)
    return g.cells(300.0 + F.col("i") * 16.0 + F.col("j") * 20.0 + F.col("v") / 100.0)


def events(spark: SparkSession, sf_dir: str) -> Raster:
    """Summed value of ``events`` by day of the month (rows) and hour (columns), 31 x 24."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.sum(F.col("value").cast("decimal(18,2)"))
    return rasterise_table(t, F.dayofmonth("ts") - 1, F.hour("ts"), v, GridSpec(24, 31, (23 * CELL, 30 * CELL)), World((23 * CELL, 30 * CELL), (0.0, 2000.0)))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per customer."""
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return t.select(F.col("c_custkey").cast("double").alias("x_m"), F.col("c_acctbal").alias("y_m"), (F.col("c_acctbal") / 10.0).alias("z_m"), (F.col("c_custkey") % 360).cast("double").alias("rotation_deg"), F.lit(1.0).alias("scale"), F.col("c_mktsegment").alias("species"))
