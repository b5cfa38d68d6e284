"""Changes and their ancestry: logs, versions of paths, provenance.

changes(id, parents array, author, ts, intent, verification, ...): the first parent is the mainline. change_files(change, path, blob).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .closure import along, levels, reach


def first_parents(changes: DataFrame) -> DataFrame:
    """(src, dst) from a change to its first parent; roots have none."""
    return changes.where(F.size("parents") > 0).select(F.col("id").alias("src"), F.col("parents")[0].alias("dst"))


def parent_edges(changes: DataFrame) -> DataFrame:
    """(src, dst, at) from a change to each parent, in order."""
    return changes.select(F.col("id").alias("src"), F.posexplode("parents").alias("at", "dst"))


def log(changes: DataFrame, heads: DataFrame) -> DataFrame:
    """The first-parent chain of heads(head): (head, id, position), position 0 being the head (G-01, SRT-07)."""
    starts = heads.select(F.col("head").alias("root"), F.col("head").alias("node"))
    way = along(starts, first_parents(changes).select(F.col("src").alias("id"), F.col("dst").alias("up")))
    return way.select(F.col("root").alias("head"), F.col("node").alias("id"), F.col("depth").alias("position"))


def ancestors(changes: DataFrame, heads: DataFrame) -> DataFrame:
    """All ancestors by every parent: (head, id), the head included (G-02)."""
    starts = heads.select(F.col("head").alias("root"), F.col("head").alias("node"))
    return reach(starts, parent_edges(changes), keep_starts=True).select(F.col("root").alias("head"), F.col("node").alias("id"))


def topological(changes: DataFrame) -> DataFrame:
    """(id, level), parents first (SRT-06); parents that aren't in the table don't count."""
    known = changes.select("id")
    edges = parent_edges(changes).join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return levels(edges, known.withColumnRenamed("id", "node")).select(F.col("node").alias("id"), "level")


def boundary(changes: DataFrame) -> DataFrame:
    """Changes with a parent outside the table (G-12)."""
    known = changes.select(F.col("id").alias("dst"))
    return parent_edges(changes).join(known, "dst", "left_anti").select(F.col("src").alias("id")).distinct()


def recent(changes: DataFrame, n: int = 200) -> DataFrame:
    """The newest n changes, with parents outside of them cut (SRC-18)."""
    kept = changes.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    inside = parent_edges(kept).join(kept.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("at", "dst"))).alias("p"))
    out = kept.drop("parents").join(inside.withColumnRenamed("src", "id"), "id", "left")
    return out.withColumn("parents", F.coalesce(F.transform("p", lambda x: x["dst"]), F.array().cast(changes.schema["parents"].dataType))).drop("p")


def path_versions(versions: DataFrame, by: str = "path", order: tuple[str, ...] = ("position",), every: int = 16) -> DataFrame:
    """versions(by, order.., blob) -> the chain of distinct consecutive blobs of each path: by, order.., blob, version (from 1), keyframe, previous (WIN-03, WIN-04, J-28)."""
    w = Window.partitionBy(by).orderBy(*order)
    changed = versions.withColumn("previous", F.lag("blob").over(w)).withColumn("at", F.row_number().over(w)).where((F.col("at") == 1) | ~F.col("blob").eqNullSafe(F.col("previous")))
    out = changed.withColumn("version", F.row_number().over(w))
    return out.withColumn("keyframe", (F.col("version") - 1) % every == 0).drop("at")


def first_ranks(versions: DataFrame, order: tuple[str, ...] = ("position", "path")) -> DataFrame:
    """(blob, first): where each blob appears first (WIN-05); the struct orders blobs as a rank would, without a window over all of them."""
    return versions.groupBy("blob").agg(F.min(F.struct(*order)).alias("first"))


def with_verification(changes: DataFrame, verifications: DataFrame, fall_back: bool = True) -> DataFrame:
    """changes with the latest recorded verification; without one (or if it says unverified), the committed value, or unverified if fall_back is off (J-07, SNK-11)."""
    side = latest(verifications, ["change"], "seq").select(F.col("change").alias("id"), F.col("v").alias("side"))
    value = F.when(F.col("side").isNull() | (F.col("side") == "unverified"), F.col("verification") if fall_back else F.lit("unverified")).otherwise(F.col("side"))
    return changes.join(side, "id", "left").withColumn("verification", F.coalesce(value, F.lit("unverified"))).drop("side")


def with_lessons(changes: DataFrame, sessions: DataFrame, lessons: DataFrame) -> DataFrame:
    """Changes that carry a lesson: that of their session, else the latest recorded afterwards (J-06)."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("task").alias("s_task"), F.col("lesson").alias("s_lesson"))
    later = latest(lessons, ["change"], "seq").select(F.col("change").alias("id"), F.col("task").alias("l_task"), F.col("lesson").alias("l_lesson"))
    own = F.when(F.col("s_lesson") != "", F.col("s_lesson"))
    out = changes.join(s, "session_id", "left").join(later, "id", "left").withColumn("lesson", F.coalesce(own, F.col("l_lesson")))
    out = out.withColumn("task", F.when(own.isNotNull(), F.col("s_task")).otherwise(F.coalesce("l_task", "s_task")))
    return out.where("lesson <> ''").drop("s_task", "s_lesson", "l_task", "l_lesson")


def why(versions: DataFrame, changes: DataFrame, sessions: DataFrame, verifications: DataFrame, limit: int = 10) -> DataFrame:
    """The newest `limit` changes of each path that altered it, with session and recorded verification (J-08, SRT-05). versions(path, change, position, blob), position 0 newest."""
    w = Window.partitionBy("path").orderBy(F.desc("position"))
    newest = Window.partitionBy("path").orderBy("position")
    altered = versions.withColumn("before", F.lag("blob").over(w)).where(~F.col("blob").eqNullSafe(F.col("before"))).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)
    full = with_verification(changes, verifications, fall_back=False).select(F.col("id").alias("change"), "author", "ts", "intent", "session_id", "verification")
    s = sessions.select(F.col("id").alias("session_id"), "task", "lesson", "model")
    return altered.drop("before").join(full, "change").join(s, "session_id", "left")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key, the row of the greatest order: reading an append-only table in which the last write wins (SNK-08, SNK-09, WIN-10)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def help_scores(lessons: DataFrame, bumps: DataFrame) -> DataFrame:
    """lessons(lesson) with the sum of their bumps(lesson, delta), 0 without (SNK-15, X-48, J-27)."""
    return lessons.select("lesson").distinct().join(bumps.groupBy("lesson").agg(F.sum("delta").alias("help")), "lesson", "left").withColumn("help", F.coalesce("help", F.lit(0)))
