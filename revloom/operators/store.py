"""The store as append-only tables: key-value namespaces, refs, commits, the operation log.

Tables are read latest-wins (history.latest); a writer appends rows with a greater seq. One driver writes at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import history, objects, retrieve


def namespace(kv: DataFrame, ns: str, key: str | None = None) -> DataFrame:
    """The live values of kv(ns, key, value, seq) in a namespace; a null value is a deletion (SRC-07, SRC-08, SNK-09, X-49)."""
    rows = kv.where(F.col("ns") == ns)
    rows = rows if key is None else rows.where(F.col("key") == key)
    return history.latest(rows.select("key", "value", "seq"), ["key"], "seq").where("value is not null").select("key", "value")


def get_or_insert(kv: DataFrame, ns: str, wanted: DataFrame) -> DataFrame:
    """What wanted(key, value) has to append: keys that the namespace lacks (SNK-10, X-16)."""
    return wanted.dropDuplicates(["key"]).join(namespace(kv, ns).select("key"), "key", "left_anti").withColumn("ns", F.lit(ns))


def ids(*tables: DataFrame) -> DataFrame:
    """Every stored id, whatever its form (SRC-06, SRC-09)."""
    out = tables[0].select("id")
    for t in tables[1:]:
        out = out.unionByName(t.select("id"))
    return out.distinct()


def point_read(rows: DataFrame, id_: str) -> DataFrame:
    """An object with whether its content still has its id (SRC-05)."""
    return rows.where(F.col("id") == id_).withColumn("ok", F.sha2("content", 256) == F.col("id"))


def refs(log: DataFrame) -> DataFrame:
    """log(name, id, seq) -> the present refs; a null id deletes (SNK-08)."""
    return history.latest(log, ["name"], "seq").where("id is not null").select("name", "id")


def swap(log: DataFrame, name: str, expected: str | None, new: str) -> DataFrame | None:
    """The row that moves a ref, or None if it isn't where expected (SNK-05)."""
    now = [r["id"] for r in refs(log.where(F.col("name") == name)).collect()]  # one row at most
    if (now[0] if now else None) != expected:
        return None
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0))).collect()[0][0]
    return log.sparkSession.createDataFrame([(name, new, last + 1)], "name string, id string, seq long")


def commit(changes: DataFrame, log: DataFrame, ref: str, row: dict, parents: list[str] | None = None, tries: int = 64) -> tuple[DataFrame, DataFrame]:
    """The change to append and the ref's new row; without parents, the ref's head is the parent, read again if it moved (SNK-04, SNK-06, SNK-07, X-02)."""
    spark = changes.sparkSession
    for _ in range(tries):
        head = [r["id"] for r in refs(log.where(F.col("name") == ref)).collect()]
        own = parents if parents is not None else head
        body = spark.createDataFrame([(own, row["tree_id"], row.get("session_id"), row["intent"], row["author"], row["ts"], row.get("verification", "unverified"))], "parents array<string>, tree_id string, session_id string, intent string, author string, ts long, verification string")
        new = body.withColumn("id", objects.object_id("change", F.to_json(F.struct(*body.columns))))
        moved = swap(log, ref, head[0] if head else None, new.collect()[0]["id"])
        if moved is not None:
            return new, moved
    raise RuntimeError("the ref kept moving")


def undo(ops: DataFrame, head: str) -> DataFrame:
    """ops(seq, before, after): the last operation if the head is still where it left it, else nothing (X-62)."""
    last = ops.orderBy(F.desc("seq")).limit(1)
    return last.where(F.col("after") == head)


def compact_log(log: DataFrame, first: int = 0, n: int = 20, contains: str | None = None) -> DataFrame:
    """log(position, id, intent, ...): a range, those that contain a text (X-63)."""
    rows = log.where(F.col("position") >= first)
    rows = rows if contains is None else rows.where(F.contains(F.lower("intent"), F.lit(contains.lower())))
    return rows.orderBy("position").limit(n)


def learned(served: DataFrame, change: str, task: str, lesson: str, seq: int) -> tuple[DataFrame, DataFrame]:
    """The lesson of a change, and links to the lessons of served(seq, lesson) by the last brief (X-25, SNK-13, SNK-14, SNK-26)."""
    spark = served.sparkSession
    last = served.agg(F.max("seq").alias("seq"))
    links = served.join(F.broadcast(last), "seq").select(F.lit(change).alias("change"), "lesson").distinct()
    return spark.createDataFrame([(change, task, lesson, seq)], "change string, task string, lesson string, seq long"), links


def reindexed(texts: DataFrame) -> DataFrame:
    """All tags anew (SNK-18, X-22)."""
    return retrieve.tags(texts)


def sessions_of(log: DataFrame, sessions: DataFrame, path_changes: DataFrame | None = None) -> DataFrame:
    """Changes of a log with their sessions, of one path if path_changes(change) names its changes (X-34)."""
    rows = log if path_changes is None else log.join(path_changes.select(F.col("change").alias("id")), "id", "left_semi")
    s = sessions.select(F.col("id").alias("session_id"), "task", "lesson", "model")
    return rows.join(s, "session_id")


def replaceable(events: DataFrame) -> DataFrame:
    """events(kind, author, d, created_at, seq, ...): the last of each kind, author and tag; of one time, the later arrival (WIN-10, SRC-37)."""
    return history.latest(events.withColumn("at", F.struct("created_at", "seq")), ["kind", "author", "d"], "at").drop("at").orderBy(F.desc("created_at"))


def pins(log: DataFrame) -> DataFrame:
    """log(symbol, lesson, seq) -> the lesson pinned to each symbol, by symbol: a later pin overwrites, a null lesson takes the pin away (SNK-12, X-33)."""
    return history.latest(log, ["symbol"], "seq").where("lesson is not null").select("symbol", "lesson").orderBy("symbol")


def bytes_at(listing: DataFrame, wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """The content at wanted(change, path), by way of listing(change, path, id) of files only; a path that is no file, or whose blob is gone, gives no row (FLT-14). blobs(id, content)."""
    return wanted.distinct().join(listing.select("change", "path", "id"), ["change", "path"]).join(blobs.select("id", "content"), "id").select("change", "path", "id", "content")
