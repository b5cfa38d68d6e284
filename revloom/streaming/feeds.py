"""Change feeds kept up to date by streams: dependency edges, the dirty set, windows over events, presence."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, trees


class Versions:
    """A table as numbered folders, the newest complete one being its content: written by a streaming sink of one writer, safe to run again."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _done(self) -> list[int]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        done = [v for v in self._done() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{done[-1]}") if done else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")


def maintain_edges(changes: DataFrame, store: Versions, checkpoint: str):
    """changes(seq, src, deleted, dsts array): each micro-batch replaces the edges of its sources by what their last change says (STR-01 to STR-03, SNK-23). Starts and returns the query."""

    def batch(df: DataFrame, epoch: int) -> None:
        last = df.groupBy("src").agg(F.max_by(F.struct("deleted", "dsts"), "seq").alias("r")).select("src", "r.*")
        found = last.where("not deleted").select("src", F.explode("dsts").alias("dst")).distinct()
        store.write(graph.reindexed(store.read(epoch), last, found), epoch)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_status(stats: DataFrame, head: DataFrame, store: Versions, checkpoint: str):
    """stats(seq, path, id; id null for a deleted file) against head(path, id, mode): the table of paths that differ from head, by id alone (STR-04, STR-05, STR-14, X-44)."""

    def batch(df: DataFrame, epoch: int) -> None:
        last = df.groupBy("path").agg(F.max_by(F.struct("id"), "seq").alias("r")).select("path", "r.id")
        known = head.join(last.select("path"), "path", "left_semi")
        now = trees.diff(known, last.where("id is not null").withColumn("mode", F.lit(0)), with_mode=False).select("path", "kind")
        store.write(store.read(epoch).join(last.select("path"), "path", "left_anti").unionByName(now), epoch)

    return stats.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of events(ts, event_type, value) in tumbling or sliding windows; rows later than `late` behind the newest don't count (STR-18)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "600 seconds", late: str = "1 hour") -> DataFrame:
    """The spans of activity of each user (WIN-13 as a stream)."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def unseen(rows: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose keys weren't seen before: what is unchanged since the last look goes (STR-16)."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def not_shown(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """rows(file, hash, ...) that a reader hasn't been shown (STR-17)."""
    return rows.join(shown.select("file", "hash").distinct(), ["file", "hash"], "left_anti")


def presence(events: DataFrame) -> DataFrame:
    """Announcements with their time, that of arrival where they name none (STR-12, STR-13)."""
    return events.withColumn("ts", F.coalesce("ts", F.current_timestamp()))


def registry(journal: DataFrame) -> DataFrame:
    """The open sessions of a journal(seq, op, session, repo, paths): the last report of each that wasn't ended (SRC-35, STR-15, SNK-27). Broken lines have a null op and don't count."""
    last = journal.where("op is not null").groupBy("session").agg(F.max_by(F.struct("op", "repo", "paths"), "seq").alias("r"))
    return last.where("r.op <> 'end'").select("session", "r.repo", "r.paths")


def running_total(usage: DataFrame) -> DataFrame:
    """usage(session, seq, tokens_out) with what each session has used so far (SNK-28)."""
    return usage.withColumn("total", F.sum("tokens_out").over(Window.partitionBy("session").orderBy("seq")))


def table_run(stream: DataFrame) -> DataFrame:
    """Runs a stream over what its source holds now and gives its whole output, as a table in the folder that the session's spark.checkpoint.dir names (a local one where it is unset)."""
    spark = stream.sparkSession
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    top = f"{(shared or 'file:///tmp/checkpoints').rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{top}/out").option("checkpointLocation", f"{top}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def memory_run(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what its source holds now and gives its whole output; for batches of files, and for tests."""
    name = f"q_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
