"""The brief: what someone about to change a symbol should see, assembled from small results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def within_budget(defs: DataFrame, budget: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """defs(keys.., position, text): the longest prefix of each part whose tokens (bytes / 4) stay within the budget; the first always stays (WIN-02, F-32)."""
    w = Window.partitionBy(*keys).orderBy("position")
    run = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = defs.withColumn("tokens", T.tokens_by_bytes(F.col("text"))).withColumn("run", run).withColumn("at", F.row_number().over(w))
    return ranked.where((F.col("at") == 1) | (F.col("run") <= budget)).drop("at", "run")


def ranked_sessions(candidates: DataFrame, take: int = 5, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """candidates(keys.., change, lesson, help, overlap, verified, ts, seq): once per change and once per lesson (the first seen), by help, overlap, verified, time, all descending; the first `take` (WIN-09)."""
    by_change, by_lesson = Window.partitionBy(*keys, "change").orderBy("seq"), Window.partitionBy(*keys, "lesson").orderBy("seq")
    once = candidates.withColumn("a", F.row_number().over(by_change)).where("a = 1").withColumn("b", F.row_number().over(by_lesson)).where("b = 1")
    w = Window.partitionBy(*keys).orderBy(F.desc("help"), F.desc("overlap"), F.desc("verified"), F.desc("ts"), "seq")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= take).drop("a", "b")


def neighbourhood(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(qid, file) -> (qid, file): the file, what it imports and what imports it (SET-04)."""
    out = targets.join(edges, F.col("file") == F.col("src")).select("qid", F.col("dst").alias("file"))
    into = targets.join(edges, F.col("file") == F.col("dst")).select("qid", F.col("src").alias("file"))
    return targets.select("qid", "file").unionByName(out).unionByName(into).distinct()


def pins_for(pins: DataFrame, names: DataFrame) -> DataFrame:
    """pins(symbol, lesson) of names(qid, symbol) (J-26, SRT-08)."""
    return names.join(pins, "symbol").select("qid", "symbol", "lesson").distinct()


def assemble(targets: DataFrame, definitions: DataFrame, neighbours: DataFrame, conflicts: DataFrame, sessions: DataFrame, pins: DataFrame) -> DataFrame:
    """One row per qid with nested lists of each part, and the same as JSON with keys in order (FLT-18, X-01). targets(qid, file, symbol, task); conflicts have an agent that is the qid."""

    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    out = targets
    for part in (
        listed(definitions, "definitions", "position", "file", "text"), listed(neighbours, "neighbours", "file"), listed(conflicts.withColumnRenamed("agent", "qid"), "conflicts", "held_file", "holder", "relation"),
        listed(sessions, "sessions", "rank", "change", "lesson"), listed(pins, "pins", "symbol", "lesson"),
    ):
        out = out.join(part, "qid", "left")
    columns = sorted(c for c in out.columns if c != "qid")
    return out.withColumn("json", F.to_json(F.struct(*columns)))
