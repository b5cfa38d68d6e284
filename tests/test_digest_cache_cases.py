"""Digests under a budget, rows of status, the stat cache with racing writes, and seeded cases."""

import random

import pytest
from pyspark.sql import functions as F

from revloom.functions import cases, stats
from revloom.operators import digest, semdiff, statcache


def test_budget(spark):
    rng = random.Random(1)
    pieces = [(f"v{k % 3}", f"p{k:03}", f"h{rng.randrange(3)}", rng.choice([1, 5, 30, 200])) for k in range(90)]
    shown = [(v, p, rng.choice([h, "old"])) for v, p, h, _ in pieces if rng.random() < 0.3]
    want, spent = {}, {}
    for v, p, h, size in sorted(pieces):
        at = spent.setdefault(v, 10)
        state = "seen" if (v, p, h) in shown else "shown" if at + size <= 150 else "elided"
        spent[v] += size if state == "shown" else 0
        want[v, p] = state
    known = spark.createDataFrame(shown, "viewer string, path string, hash string")
    states = digest.within_budget(spark.createDataFrame(pieces, "viewer string, path string, hash string, size long").repartition(5), known, 150, 10)
    assert {(r.viewer, r.path): r.state for r in states.collect()} == want
    total = {r.viewer: r for r in digest.summary(states, 150).collect()}
    assert all(total[v].spent == s - 10 and total[v].first_elided == min((p for (w, p), x in want.items() if w == v and x == "elided"), default=None) for v, s in spent.items())
    after = {(r.viewer, r.path): r.hash for r in digest.cursor(known, states).collect()}
    assert after == {(v, p): h for v, p, h in shown} | {(v, p): h for v, p, h, _ in pieces if want[v, p] == "shown"}
    assert digest.within_budget(spark.createDataFrame([], "viewer string, path string, hash string, size long"), known, 5).count() == 0


def test_status(spark):
    tree = "path string, id string, mode int"
    head = spark.createDataFrame([("a", "1", 0), ("b", "1", 0), ("same", "1", 0)], tree)
    work = spark.createDataFrame([("a", "2", 0, True), ("same", "1", 1, True), ("new", "1", 0, False), ("staged", "1", 0, True)], tree + ", tracked boolean")
    counts = spark.createDataFrame([("a", 3, 1, 9), ("new", 0, 0, 7), ("b", 0, 4, 0)], "path string, added int, deleted int, lines int")
    reports = spark.createDataFrame([("me", "a"), ("you", "a"), ("they", "a"), ("you", "same")], "session string, path string")
    got = {tuple(r) for r in digest.status(head, work, counts, reports, "me").collect()}
    assert got == {("M", "a", 3, 1, "they,you"), ("D", "b", 0, 4, ""), ("A?", "new", 7, 0, ""), ("A", "staged", 0, 0, "")}


def test_stat_cache(spark, tmp_path):
    cache = statcache.StatCache(spark, f"file://{tmp_path}/cache")
    rows = lambda *r: spark.createDataFrame(list(r), "path string, mtime long, size long, id string")
    read = lambda: {r.path: (r.id, r.epoch, r.trusted) for r in cache.read().collect()}
    assert read() == {} and not cache.compact()
    cache.put(rows(("a", 50, 1, "a1"), ("b", 99, 1, "b1"), ("c", 100, 1, "c1")), 100)
    cache.put(rows(), 900)  # nothing changed: the epoch stays
    assert read() == {"a": ("a1", 100, True), "b": ("b1", 100, True), "c": ("c1", 100, False)}
    cache.put(rows(("a", 120, 1, "late")), 200)
    cache.put(rows(("a", 110, 1, "early"), ("d", 1, 1, "d1")), 150)  # a racing writer that began before the last one and ends after it
    want = {"a": ("late", 200, True), "b": ("b1", 100, True), "c": ("c1", 100, True), "d": ("d1", 150, True)}
    assert read() == want
    assert cache.compact() and read() == want and not cache.compact()
    before = cache._counting()
    cache.put(rows(("e", 250, 1, "e1")), 250)
    assert not cache.compact(0.5) and read() == want | {"e": ("e1", 250, False)}
    absorbed = {r["layer"] for r in spark.read.parquet(f"{cache.path}/{before[0].replace('base', 'names', 1)}").collect()}
    assert len(absorbed) == 3 and cache.compact(0.1) and read() == want | {"e": ("e1", 250, False)}


@pytest.mark.parametrize("seed", [1094, 7])
def test_cases(spark, seed):
    """The same rows for any partitioning; recall and false alarms over twelve cases of each of six classes."""
    numbers = spark.range(12).withColumnRenamed("id", "number")
    one, many = (sorted(map(tuple, cases.cases(numbers.repartition(n), seed).collect())) for n in (1, 64))
    assert one == many and len({r[0] for r in one}) == 6
    rows = cases.cases(numbers, seed)
    assert rows.where("odd").count() == 36 and rows.groupBy("class", "number").count().where("count not between 6 and 9").isEmpty()
    part = F.concat_ws("|", "class", F.col("number").cast("string"))
    lines = rows.select(F.col("line").cast("long").alias("seq"), part.alias("file"), F.lit(None).cast("string").alias("symbol"), "text", part.alias("part"))
    both = semdiff.literal_anomalies(lines, ("part",)).select("part", "seq").unionByName(semdiff.operator_anomalies(lines, ("part",)).select("part", "seq"))
    found = both.select(F.split_part("part", F.lit("|"), F.lit(1)).alias("class"), F.split_part("part", F.lit("|"), F.lit(2)).cast("long").alias("number"), F.col("seq").cast("int").alias("line"))
    assert {(r["class"], r.rate, r.n) for r in stats.detection(cases.judged(rows, found)).collect()} == {(c, float(s != "clean"), 12) for c, s in cases.CLASSES.items()}
