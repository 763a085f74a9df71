"""Writing rasters, tiles and points, and the summary of a build."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import quantise
from ..operators.base import HEIGHT, POINTS, Raster
from ..plans.world import GridSpec, PlanError, World, runs, tiles_even

FORMATS = {"exr32", "png16", "png8", "parquet"}
POINT_FORMATS = {"csv", "json", "parquet"}


def check_format(kind: str, fmt: str) -> None:
    if fmt not in (POINT_FORMATS if kind == POINTS else FORMATS):
        raise PlanError(f"{kind} can't be written as {fmt}")


def sanitise(name: str) -> str:
    return re.sub(r"[^0-9a-z-]", "_", name.lower()).strip("_")


def sanitised(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^0-9a-z-]", "_"), F.lit("_"))


def file_name(label: str, node: str, port: str, resolution: int) -> str:
    return f"{sanitise(label)}-{sanitise(node)}_{sanitise(port)}_{resolution}"


def png_cells(r: Raster, bits: int) -> DataFrame:
    """Cells in the whole steps that a PNG holds; heights over the world's range first."""
    m = r.to("mask") if r.kind == HEIGHT else r
    return m.df.select("j", "i", *(quantise(F.col(c), (1 << bits) - 1).alias(c) for c in m.columns))


def tile_cells(r: Raster, size: int) -> DataFrame:
    """Cells with (tx, ty) of output tiles that share their edges: a cell on an edge belongs to both."""
    def touched(v: str, n: int) -> Column:
        last = max(0, -(-(n - 1) // (size - 1)) - 1)
        low = F.greatest(F.ceil((F.col(v) - (size - 1)) / (size - 1)).cast("int"), F.lit(0))
        return F.explode(F.sequence(low, F.least(F.floor(F.col(v) / (size - 1)).cast("int"), F.lit(last))))

    return r.df.withColumn("tx", touched("i", r.spec.width)).withColumn("ty", touched("j", r.spec.height))


def tile_number(spec: GridSpec, size: int) -> tuple[Column, Column]:
    """(ti, tj) of the tile whose core holds a cell; a rest below 2 belongs to the last tile."""
    of = lambda v, n: F.least(F.floor(F.col(v) / size), F.lit(len(runs(n, size)) - 1)).cast("int")
    return of("i", spec.width), of("j", spec.height)


def write_tiles(r: Raster, size: int, path: str) -> None:
    """Parquet by output tile; each tile's cells meet once."""
    tile_cells(r, size).repartition("tx", "ty").write.mode("overwrite").partitionBy("tx", "ty").parquet(path)


def csv_points(points: DataFrame) -> DataFrame:
    """Lines ``x,y,z,rotation_deg,scale,species`` with 3, 3, 3, 2 and 4 decimals."""
    return points.select(F.format_string("%.3f,%.3f,%.3f,%.2f,%.4f,%s", "x_m", "y_m", "z_m", "rotation_deg", "scale", "species").alias("line"))


def write_csv(points: DataFrame, path: str) -> None:
    cols = [F.format_string(f, c).alias(n) for f, c, n in (("%.3f", "x_m", "x"), ("%.3f", "y_m", "y"), ("%.3f", "z_m", "z"), ("%.2f", "rotation_deg", "rotation_deg"), ("%.4f", "scale", "scale"), ("%s", "species", "species"))]
    points.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_json(points: DataFrame, path: str) -> None:
    points.select(F.col("x_m").alias("x"), F.col("y_m").alias("y"), F.col("z_m").alias("z"), "rotation_deg", "scale", "species").write.mode("overwrite").json(path)


def engine_hints(world: World, spec: GridSpec) -> dict[str, float]:
    """Scales at which a 16-bit height image has the world's size."""
    span = world.span
    return {"z_scale": span * 12800.0 / 65535.0, "z_location": (world.height_range_m[0] + span / 2) * 100.0, "xy_scale": 100.0 * spec.cell[0]}


def build_summary(outputs: dict[str, Raster | DataFrame], world: World, spec: GridSpec) -> DataFrame:
    """One row per output: kind, cells or points, smallest and largest value."""
    rows = None
    for name, out in sorted(outputs.items()):
        points = not isinstance(out, Raster)
        values = ["z_m"] if points else list(out.columns)
        df = out if points else out.df
        part = df.agg(F.count(F.lit(1)).alias("count"), F.min(F.least(*values) if len(values) > 1 else F.col(values[0])).alias("low"), F.max(F.greatest(*values) if len(values) > 1 else F.col(values[0])).alias("high"))
        part = part.select(F.lit(name).alias("output"), F.lit(POINTS if points else out.kind).alias("kind"), "count", "low", "high", F.lit(spec.cell[0]).alias("cell_m"), F.lit(world.seed).cast("long").alias("seed"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def even_tiles(spec: GridSpec, size: int) -> bool:
    return tiles_even(spec.width, size) and tiles_even(spec.height, size)
