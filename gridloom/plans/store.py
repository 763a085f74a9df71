"""Results of nodes as Parquet tables under their content keys, with a budget of bytes.

A result is a folder with a table for each output and, written last, a mark
that names the outputs' kinds, so half-written results are never read. When
the results outgrow the budget, those that were used longest ago go.
"""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .world import GridSpec, World

MARK = "outputs.json"


class ResultStore:
    """Any folder that Spark can write: of one machine, or shared by a cluster's."""

    def __init__(self, spark: SparkSession, path: str, budget_bytes: int = 8 << 30):
        self.spark, self.path, self.budget = spark, path.rstrip("/"), budget_bytes
        self.evictions = 0
        self._used: dict[str, float] = {}

    def _at(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, key: str, outputs: dict[str, Any]) -> None:
        """Writes all outputs and makes room."""
        from ..operators import Raster

        kinds = {}
        for port, out in outputs.items():
            df = out if isinstance(out, DataFrame) else out.df
            df.write.mode("overwrite").parquet(f"{self.path}/{key}/{port}")
            kinds[port] = out.kind if isinstance(out, Raster) else None
        path, files = self._at(key, MARK)
        stream = files.create(path, True)
        stream.write(bytearray(json.dumps(kinds).encode()))
        stream.close()
        self._used[key] = time.monotonic()
        self.evict(keep=key)

    def get(self, key: str, spec: GridSpec, world: World) -> dict[str, Any] | None:
        from ..operators import Raster

        path, files = self._at(key, MARK)
        if not files.exists(path):
            return None
        kinds = json.loads("".join(r[0] for r in self.spark.read.text(path.toString()).collect()))
        self._used[key] = time.monotonic()
        read = {port: self.spark.read.parquet(f"{self.path}/{key}/{port}") for port in kinds}
        return {port: df if kinds[port] is None else Raster(df, spec, world, kinds[port]) for port, df in read.items()}

    def sizes(self) -> dict[str, int]:
        """Bytes of each result."""
        path, files = self._at()
        if not files.exists(path):
            return {}
        return {s.getPath().getName(): files.getContentSummary(s.getPath()).getLength() for s in files.listStatus(path) if s.isDirectory()}

    def evict(self, keep: str | None = None) -> list[str]:
        """Deletes the results used longest ago until the rest fits; those of earlier sessions first."""
        sizes, gone = self.sizes(), []
        for key in sorted(sizes, key=lambda k: (self._used.get(k, 0.0), k)):
            if sum(sizes.values()) <= self.budget:
                break
            if key != keep:
                path, files = self._at(key)
                files.delete(path, True)
                del sizes[key]
                gone.append(key)
        self.evictions += len(gone)
        return gone
