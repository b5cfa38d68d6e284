"""What a viewer of a working set is shown: pieces that fit a budget and weren't shown before, and rows of status (FLT-21, X-60)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import diff

PIECE = "viewer string, path string, hash string, size long, state string"


def _fold(budget: int):
    """Pieces in order, viewer by viewer: one that fits into what is left of the budget is shown, one that doesn't is passed over."""

    def run(batches):
        viewer, spent = None, 0
        for b in batches:
            states = []
            for who, size, seen, base in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
                if who != viewer:
                    viewer, spent = who, base
                if seen:
                    states.append("seen")
                elif spent + size <= budget:
                    spent += size
                    states.append("shown")
                else:
                    states.append("elided")
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(states, pa.string())], names=["viewer", "path", "hash", "size", "state"])

    return run


def within_budget(pieces: DataFrame, shown: DataFrame, budget: int, base: int = 0) -> DataFrame:
    """pieces(viewer, path, hash, size), shown(viewer, path, hash) -> each piece with its state: `seen` if the viewer was shown this very content, else in the order of paths `shown` if it fits beside what was shown before it (and `base`), or `elided`.

    A cursor holds one content a path; of several, any counts as shown. What can't fit at all is elided at once; the rest of a viewer's pieces pass through one task as a stream that keeps one number, since what fits depends on all before."""
    known = shown.select("viewer", "path", "hash").distinct().withColumn("was", F.lit(True))
    x = pieces.join(known, ["viewer", "path", "hash"], "left").select("viewer", "path", "hash", F.col("size").cast("long").alias("size"), F.coalesce("was", F.lit(False)).alias("seen"), F.lit(base).cast("long").alias("base"))
    large = F.lit(base) + F.col("size") > budget
    fold = x.where(F.col("seen") | ~large).repartition("viewer").sortWithinPartitions("viewer", "path", "hash").mapInArrow(_fold(budget), PIECE)
    return fold.unionByName(x.where(~F.col("seen") & large).select("viewer", "path", "hash", "size", F.lit("elided").alias("state")))


def summary(states: DataFrame, budget: int) -> DataFrame:
    """Each viewer's counts, what was spent, and the first path that was left out, with the budget to ask for next (four times this one)."""
    some = lambda s: F.count_if(F.col("state") == s).alias(s)
    first = F.min(F.when(F.col("state") == "elided", F.col("path")))
    return states.groupBy("viewer").agg(some("shown"), some("seen"), some("elided"), F.coalesce(F.sum(F.when(F.col("state") == "shown", F.col("size"))), F.lit(0)).alias("spent"), first.alias("first_elided"), F.when(first.isNotNull(), F.lit(4 * budget)).alias("expand"))


def cursor(shown: DataFrame, states: DataFrame) -> DataFrame:
    """The cursor after a look: (viewer, path, hash), a path's new content in place of what was shown before."""
    new = states.where("state = 'shown'").groupBy("viewer", "path").agg(F.max("hash").alias("hash"))
    return shown.select("viewer", "path", "hash").join(new.select("viewer", "path"), ["viewer", "path"], "left_anti").unionByName(new)


def status(head: DataFrame, work: DataFrame, counts: DataFrame, reports: DataFrame, session: str) -> DataFrame:
    """head(path, id, mode), work(path, id, mode, tracked), counts(path, added, deleted, lines), reports(session, path) -> (s, p, added, deleted, overlap): a row for each path that differs, with a marker (A? for one that isn't tracked yet), lines, all of
    its lines where it isn't tracked, and the other sessions that report the path."""
    kinds = diff(head, work.select("path", "id", "mode"), with_mode=False).select("path", "kind")
    letter = F.upper(F.substring("kind", 1, 1))
    new = work.where("not tracked").select("path", F.lit(True).alias("new"))
    others = reports.where(F.col("session") != session).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("session")), ",").alias("overlap"))
    x = kinds.join(new, "path", "left").join(counts.select("path", "added", "deleted", "lines"), "path", "left").join(others, "path", "left")
    lone = F.coalesce("new", F.lit(False))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return x.select(F.when(lone, "A?").otherwise(letter).alias("s"), F.col("path").alias("p"), F.when(lone, count(F.col("lines"))).otherwise(count(F.col("added"))).alias("added"), F.when(lone, 0).otherwise(count(F.col("deleted"))).cast("long").alias("deleted"), F.coalesce("overlap", F.lit("")).alias("overlap"))
