"""What the text operators share: the shared folder, written tables, table reading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []

FAN_IN = 16
SHARE, SALTS, FEW = 1000, 200, 1000
SLICE = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; only where it is unset, an own one (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _own.append(tempfile.mkdtemp(prefix="revloom-", dir="/tmp/checkpoints"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/revloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of plans that are done; else they stay until the driver happens to collect
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() returned. Only for those that nothing still to be computed reads, be it anew after the loss of an executor."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id, mod: int):
    """crc32(doc_id as text) mod `mod` is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 0, F.lit(False))


def pow2_at_least(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE):
    """The batch in parts whose binary column has about `most` bytes each (one row at least), so that what is computed for a part is bounded by its longest text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def salted_join(rows: DataFrame, info: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with info (few rows for each key), whatever share of the rows one key has.

    The keys with at least 1 / SHARE of the rows, of which there are at most SHARE, are found by an aggregate of key hashes, or in counts, which has each key once with its `count` of rows; each is
    dealt over SALTS tasks, to which info's rows of that key go all. rows (or counts) are read twice and should be a table. Null keys of rows match nothing and stay where they are."""
    key = F.xxhash64(*on)
    n = rows.count()
    heavy = [r["k"] for r in (rows.groupBy(key.alias("k")).count() if counts is None else counts.select(key.alias("k"), "count")).where((F.col("count") * SHARE >= n) & (F.col("count") > FEW)).collect()]  # at most SHARE numbers
    if not heavy:
        return rows.join(info, on, how)
    left = rows.withColumn("__salt", F.when(key.isin(heavy), F.floor(F.rand(7) * SALTS).cast("int")).otherwise(F.lit(0)))
    right = info.withColumn("__salt", F.explode(F.when(key.isin(heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def total(df: DataFrame, partial, kind=np.float64) -> np.ndarray | None:
    """The sum over partitions of the array that partial(batches) returns; no task gets more than about FAN_IN of them."""

    def row(x):
        packed = zlib.compress(x.tobytes(), 1)
        return pa.RecordBatch.from_pydict({"part": pa.array([zlib.crc32(packed)], pa.int64()), "v": pa.array([packed], pa.binary())})

    def first(batches):
        got = partial(batches)
        if got is not None:
            yield row(got.astype(kind))

    def add(batches):
        out = None
        for b in batches:
            for v in b.column(1).to_pylist():
                x = np.frombuffer(zlib.decompress(v), kind)
                out = x.copy() if out is None else out + x
        if out is not None:
            yield row(out)

    n, rows = df.rdd.getNumPartitions(), df.mapInArrow(first, "part long, v binary")
    while n > 1:
        n = -(-n // FAN_IN)
        rows = rows.repartition(n, "part").mapInArrow(add, "part long, v binary")
    got = [np.frombuffer(zlib.decompress(r["v"]), kind) for r in rows.collect()]
    return sum(got[1:], got[0]) if got else None
