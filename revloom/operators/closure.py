"""Bounded and unbounded closures over edge tables, by frontiers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import dealt_join


def _cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the folder that the session names, or, where it names none, a local one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="closure-", dir="/tmp/checkpoints"))
    return df.checkpoint()


def reach(starts: DataFrame, edges: DataFrame, depth: int | None = None, keep_starts: bool = False) -> DataFrame:
    """Everything that edges(src, dst) reach from starts(root, node): (root, node, depth), depth being the least number of steps; a start is left out unless keep_starts. Cycles are safe: only new nodes go on. G-02 to G-04, G-06, G-07.

    A round takes `hop` steps by a table of all pairs up to that far apart. It goes on from the nodes exactly `at` steps away, through which the shortest ways of all farther ones lead. The table is taken twice as far where that makes
    no more rows than were found so far, so deep graphs take few rounds and work stays in proportion to what is found."""
    frontier = _cut(starts.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    seen, at, hop, rows, ahead = frontier, 0, 1, frontier.count(), None
    links = _cut(edges.select("src", "dst").distinct().withColumn("n", F.lit(1)))  # else every step would compute the edges anew
    while depth is None or at < depth:
        if ahead is None:
            into = links.where(F.col("n") == hop).groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("i"))
            ahead = into.join(links.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("o")), "mid").agg(F.sum(F.col("i") * F.col("o"))).collect()[0][0] or 0
        if 0 < ahead <= rows:
            far = links.where(F.col("n") == hop).select("src", F.col("dst").alias("mid")).join(links.select(F.col("src").alias("mid"), "dst", (F.col("n") + hop).alias("n")), "mid").where("src <> dst").select("src", "dst", "n")
            links = _cut(links.unionByName(far).groupBy("src", "dst").agg(F.min("n").alias("n")))
            hop, ahead = hop * 2, None
        near = links if depth is None else links.where(F.col("n") <= depth - at)
        step = frontier.join(near, frontier["node"] == near["src"]).groupBy("root", F.col("dst").alias("node")).agg((F.min("n") + at).cast("int").alias("depth"))
        new = _cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        found = new.count()
        if not found:
            break
        seen, at, rows = seen.unionByName(new), at + hop, rows + found
        frontier = new.where(F.col("depth") == at)
    return seen if keep_starts else seen.where("depth > 0")


def ends(pointers: DataFrame) -> DataFrame:
    """pointers(id, up), each id once -> (id, last, depth): where the way up ends, and after how many steps; last is null (and depth too) where it runs into a cycle. Pointers are doubled: log2 rounds for the longest way that ends.

    A way has all shorter ones in it, so a round in which none ends leaves only those that run into a cycle. States are as large as the table, so they are never broadcast, however small Spark estimates them."""
    state = _cut(pointers.select("id", F.col("up").alias("last"), F.lit(1).cast("long").alias("depth")))
    before = state.count()
    while True:
        inner = state.select(F.col("id").alias("last"), F.col("last").alias("next"), F.col("depth").alias("d"))
        x = dealt_join(state, inner.hint("merge"), ["last"], "left")
        state = _cut(x.select("id", F.coalesce("next", "last").alias("last"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        moved = state.where("moved").count()
        if moved in (0, before):
            return state.select("id", *(F.when(~F.col("moved"), F.col(c)).alias(c) for c in ("last", "depth")))
        state, before = state.drop("moved"), moved


def along(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """starts(root, node), pointers(id, up), each id once and without a cycle -> (root, node, depth): all nodes on the way up from each start, itself at depth 0. Each round joins what is known with jumps of twice the length, so that
    a way of n steps takes log2(n) rounds."""
    seen = _cut(starts.select("root", "node", F.lit(0).cast("long").alias("depth")))
    jump, length = _cut(pointers.select(F.col("id").alias("node"), F.col("up").alias("to"))), 1
    most = jump.count()
    while length <= most:
        more = dealt_join(seen, jump, ["node"]).select("root", F.col("to").alias("node"), (F.col("depth") + length).alias("depth"))
        more = _cut(more)
        if more.isEmpty():
            break
        seen = seen.unionByName(more)
        jump, length = _cut(jump.withColumnRenamed("to", "mid").join(jump.select(F.col("node").alias("mid"), "to"), "mid").select("node", "to")), length * 2
    return seen


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level) of an acyclic graph edges(src, dst), level being the longest path that ends at the node (SRT-06). Kahn's order in rounds: a node is placed once all its sources are."""
    left = _cut(edges.select("src", "dst").distinct())
    todo = _cut(nodes.select("node").distinct())
    placed, level = None, 0
    while not todo.isEmpty():
        free = _cut(todo.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        row = free.withColumn("level", F.lit(level))
        placed = row if placed is None else placed.unionByName(row)
        todo = _cut(todo.join(free, "node", "left_anti"))
        left = _cut(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        level += 1
    return placed if placed is not None else nodes.select("node").withColumn("level", F.lit(0)).limit(0)
