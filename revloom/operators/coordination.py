"""Reservations, as tables: who holds which file, and whom a plan would disturb.

holds(file, agent, task, taken): taken in seconds. A hold lives while now - taken < ttl; a clock that ran backwards counts as no time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TTL = 600


def age(taken, now):
    """F-55."""
    return F.greatest(F.lit(now) - taken, F.lit(0))


def live(holds: DataFrame, now: int, ttl: int = TTL) -> DataFrame:
    """STR-08, X-08, X-09."""
    return holds.where(age(F.col("taken"), now) < ttl)


def snapshot(holds: DataFrame, now: int, ttl: int = TTL) -> DataFrame:
    """Live holds by file with their age and what is left (SRT-09, X-05)."""
    a = age(F.col("taken"), now)
    return live(holds, now, ttl).select("file", "agent", "task", a.alias("age"), (F.lit(ttl) - a).alias("left")).orderBy("file")


def restored(holds: DataFrame, now: int, ttl: int = TTL) -> DataFrame:
    """What a restart takes over: live holds, stamps of the future set to now (STR-10, SRC-34)."""
    return live(holds, now, ttl).withColumn("taken", F.least("taken", F.lit(now)))


def conflicts(holds: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(agent, file): files that another agent holds (J-11)."""
    h = holds.select("file", F.col("agent").alias("holder"), "task")
    return wanted.join(h, "file").where("holder <> agent").select("agent", "file", "holder", "task")


def reserve(holds: DataFrame, wanted: DataFrame, now: int, ttl: int = TTL) -> DataFrame:
    """The holds after wanted(agent, task, file, seq) are taken where free, in order of seq; an agent's own are renewed (J-12)."""
    kept = live(holds, now, ttl)
    first = wanted.groupBy("file").agg(F.min_by(F.struct("agent", "task"), F.col("seq")).alias("w")).select("file", "w.agent", "w.task")
    both = kept.select("file", F.struct("agent", "task", "taken").alias("h")).join(first.select("file", F.struct("agent", "task").alias("w")), "file", "full_outer")
    takes = F.col("h").isNull() | (F.col("h.agent") == F.col("w.agent"))
    mine = F.struct(F.col("w.agent").alias("agent"), F.col("w.task").alias("task"), F.lit(now).cast("long").alias("taken"))
    old = F.struct(F.col("h.agent").alias("agent"), F.col("h.task").alias("task"), F.col("h.taken").cast("long").alias("taken"))
    return both.select("file", F.when(F.col("w").isNotNull() & takes, mine).otherwise(old).alias("r")).select("file", "r.*")


def release(holds: DataFrame, agent: str, files: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The holds left, and how many went (STR-09, X-07)."""
    mine = F.col("agent") == agent
    mine = mine & F.col("file").isin(files) if files is not None else mine
    return holds.where(~mine), holds.where(mine).agg(F.count("*").alias("freed"))


def held_by_others(holds: DataFrame, agent: str) -> DataFrame:
    """SET-06."""
    return holds.where(F.col("agent") != agent).select("file").distinct().orderBy("file")


def predict(holds: DataFrame, wanted: DataFrame, edges: DataFrame, shared: DataFrame) -> DataFrame:
    """Holds of others that touch what an agent wants: wanted(agent, file), edges(src, dst) of imports, shared(file, other) of symbols -> (agent, held_file, holder, task, relation) (J-13).

    Of several relations the closest counts: imports, imported-by, shared-symbol, same-dir. Wanted files themselves don't count; files of the root share no directory. Each relation is an equi-join; the closest
    is the least rank."""
    h = holds.select(F.col("file").alias("held_file"), F.col("agent").alias("holder"), "task")
    imports = wanted.join(edges, F.col("file") == F.col("src")).select("agent", F.col("dst").alias("held_file"), F.lit(0).alias("rank"))
    imported = wanted.join(edges, F.col("file") == F.col("dst")).select("agent", F.col("src").alias("held_file"), F.lit(1).alias("rank"))
    symbol = wanted.join(shared, "file").select("agent", F.col("other").alias("held_file"), F.lit(2).alias("rank"))
    dirs = wanted.select("agent", T.directory(F.col("file")).alias("dir")).where("dir <> ''").distinct()
    near = h.withColumn("dir", T.directory(F.col("held_file"))).join(dirs, "dir").select("agent", "held_file", F.lit(3).alias("rank"))
    ranks = imports.unionByName(imported).unionByName(symbol).unionByName(near).groupBy("agent", "held_file").agg(F.min("rank").alias("rank"))
    own = wanted.select("agent", F.col("file").alias("held_file"))
    met = ranks.join(own, ["agent", "held_file"], "left_anti").join(h, "held_file").where("holder <> agent")
    return met.select("agent", "held_file", "holder", "task", F.element_at(F.array(*map(F.lit, ("imports", "imported-by", "shared-symbol", "same-dir"))), F.col("rank") + 1).alias("relation"))


def glob_collisions(claims: DataFrame, asked: DataFrame) -> DataFrame:
    """claims(session, glob) against asked(session, glob): claims of other sessions that overlap (J-23, X-64).

    Two prefixes overlap if one is the other or a directory above it. Every prefix is therefore expanded to itself and the directories above, which makes both directions equi-joins; an empty prefix meets all."""

    def side(df, s, g):
        return df.select(F.col("session").alias(s), F.col("glob").alias(g), T.glob_prefix(F.col("glob")).alias("p"))

    a, b = side(asked, "session", "glob"), side(claims, "other", "other_glob")
    up = lambda df: df.withColumn("at", F.explode(F.array_append(F.array_append(T.ancestors_of(F.col("p")), F.col("p")), F.lit(""))))
    below = up(a).withColumnRenamed("p", "pa").join(b.withColumnRenamed("p", "at"), "at").select("session", "glob", "other", "other_glob")
    above = up(b).withColumnRenamed("p", "pb").join(a.withColumnRenamed("p", "at"), "at").select("session", "glob", "other", "other_glob")
    return below.unionByName(above).where("session <> other").distinct()


def path_overlaps(paths: DataFrame) -> DataFrame:
    """paths(session, repo, path): pairs of sessions on one path (J-24); every row names one session and how many others are on its path, so that a popular path stays linear."""
    n = paths.select("repo", "path", "session").distinct().groupBy("repo", "path").agg(F.count("*").alias("sessions"))
    return paths.select("session", "repo", "path").distinct().join(n.where("sessions > 1"), ["repo", "path"]).select("session", "repo", "path", (F.col("sessions") - 1).alias("others"))


def hold_spans(events: DataFrame, keys: tuple[str, ...] = ("agent", "file"), ttl: int = TTL) -> DataFrame:
    """events(keys.., ts in seconds) -> the spans in which a hold stayed alive: a gap of ttl or more ends one (WIN-13)."""
    w = Window.partitionBy(*keys).orderBy("ts")
    fresh = F.coalesce((F.col("ts") - F.lag("ts").over(w) >= ttl).cast("int"), F.lit(1))
    numbered = events.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(w))
    return numbered.groupBy(*keys, "span").agg(F.min("ts").alias("began"), F.max("ts").alias("last"), F.count("*").alias("events"))
