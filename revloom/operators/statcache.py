"""A stat cache as layers: each write appends its entries with the epoch that it began at, reads merge them, and a compaction folds them into one (SNK-25, F-56).

An entry is columns: path, mtime (ns), size, id. Of a path's entries the one of the newest epoch counts. An entry is trusted if its time lies before the newest epoch of all: a file that changed in or after the instant in which the walk began may
have changed again without a new time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "path string, mtime long, size long, id string, epoch long"


def merged(layers: DataFrame) -> DataFrame:
    """layers(path, mtime, size, id, epoch) -> the entry of each path that counts, with `trusted`. Of entries of one epoch the latest time counts, then the larger size and id."""
    last = layers.groupBy("path").agg(F.max(F.struct("epoch", "mtime", "size", "id")).alias("r")).select("path", "r.mtime", "r.size", "r.id", "r.epoch")
    newest = layers.agg(F.max("epoch").alias("newest"))
    return last.join(F.broadcast(newest)).withColumn("trusted", F.col("mtime") < F.col("newest")).drop("newest")  # one row


class StatCache:
    """Layers in a folder that driver and executors share. Writers don't wait for one another: each adds a folder of its own, which counts from when it is complete. A compaction writes a base that names the layers in it; readers take the newest
    base and all layers outside of it, so that nothing is lost that is added meanwhile, and one that dies half way changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _layers(self) -> list[str]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def _counting(self) -> tuple[str | None, list[str]]:
        """The newest base, and the layers outside of it."""
        done = self._layers()
        bases = [x for x in done if x.startswith("base-")]
        base = bases[-1] if bases else None
        absorbed = {r["layer"] for r in self.spark.read.parquet(f"{self.path}/{base.replace('base', 'names', 1)}").collect()} if base else set()  # names of folders
        return base, [x for x in done if x.startswith("delta-") and x not in absorbed]

    def put(self, updates: DataFrame, epoch: int) -> None:
        """Adds updates(path, mtime, size, id) of a walk that began at `epoch`; none write nothing, so that the epoch before stays."""
        if not updates.isEmpty():
            updates.select("path", "mtime", "size", "id", F.lit(epoch).cast("long").alias("epoch")).write.parquet(f"{self.path}/delta-{epoch:020d}-{uuid.uuid4().hex}")

    def layers(self) -> DataFrame:
        base, deltas = self._counting()
        some = [f"{self.path}/{x}" for x in ([base] if base else []) + deltas]
        return self.spark.read.schema(ENTRY).parquet(*some) if some else self.spark.createDataFrame([], ENTRY)

    def read(self) -> DataFrame:
        return merged(self.layers())

    def compact(self, share: float = 0.25) -> bool:
        """Folds the layers into a new base if those outside of the present one have more than `share` of its rows. Old folders stay for readers that have begun; nothing reads them from then on."""
        base, deltas = self._counting()
        if not deltas:
            return False
        count = lambda names: self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/{x}" for x in names]).count()
        if base and count(deltas) <= share * count([base]):
            return False
        at = f"{max([int(x.split('-')[1]) for x in self._layers() if x.startswith('base-')], default=0) + 1:020d}-{uuid.uuid4().hex}"
        absorbed = [x for x in self._layers() if x.startswith("delta-") and x not in deltas] + deltas
        self.spark.createDataFrame([(x,) for x in absorbed], "layer string").coalesce(1).write.parquet(f"{self.path}/names-{at}")
        some = self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/{x}" for x in ([base] if base else []) + deltas])
        merged(some).drop("trusted").write.parquet(f"{self.path}/base-{at}")  # it counts from here on
        return True
