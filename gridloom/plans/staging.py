"""Cutting lineage with tables in the folder that all executors share, and components of graphs by such rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where it is unset and one machine does all work, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
    if not written:
        atexit.register(clean)
    written.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean() -> None:
    """Deletes every table written by this process."""
    for spark, path in written:
        try:
            delete(spark, path)
        except Exception:  # the session may be over
            return
    written.clear()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is the smallest node that it is connected to.

    Edges point from the larger node to the smaller. A round ties all smaller
    neighbours of a node to the smallest of them, which leaves few different
    edges of a dense group, and then lets each edge skip to what its smaller
    node points at. Rounds end when every node points at one root. Each is a
    table in the shared folder.
    """
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        low = down.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        tied = low.select("u", F.col("m").alias("v")).union(low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        tied = staged(tied, "tied")
        least = tied.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_v"), F.count(F.lit(1)).alias("_n"))
        skip = tied.join(least, F.col("v") == F.col("_u"), "left").select("u", F.coalesce("_v", "v").alias("v"), F.col("_v").isNotNull().alias("moved"))
        if not least.where("_n > 1").limit(1).count() and not skip.where("moved").limit(1).count():
            return tied.select(F.col("u").alias("node"), F.col("v").alias("root")).union(tied.select("v", "v").distinct())
        down = skip.select("u", "v").distinct()
