"""The reservation stream against a plain registry, and its restart from an old snapshot."""

import random
import time

import pytest

from revloom.streaming import feeds, holds

SCHEMA = "repo string, agent string, file string, task string, kind string, ts long, seq long"


def plain(events, ttl=600, held=None):
    """What a registry of one dictionary does."""
    held, out = dict(held or {}), []
    for repo, agent, file, task, kind, ts, _ in sorted(events, key=lambda e: (e[5], e[6])):
        for k in [k for k, h in held.items() if not ts - h[2] < ttl]:
            del held[k]
        if kind == "reserve" and file is not None:
            h = held.get((repo, file))
            free = h is None or h[0] == agent
            if free:
                held[repo, file] = (agent, task, ts)
            out.append((repo, ts, kind, file, agent, held[repo, file][0], free))
        elif kind in ("heartbeat", "release"):
            for (r, f), h in sorted(held.items()):
                if r == repo and h[0] == agent and (kind == "heartbeat" or file in (None, f)):
                    if kind == "heartbeat":
                        held[r, f] = (agent, h[1], ts)
                    else:
                        del held[r, f]
                    out.append((repo, ts, kind, f, agent, agent if kind == "heartbeat" else None, True))
    return sorted(out, key=repr), held


def some(rng, n, first=0):
    kinds = ["reserve"] * 5 + ["heartbeat"] * 3 + ["release"]
    rows = []
    for k in range(n):
        kind = rng.choice(kinds)
        file = None if kind == "heartbeat" or kind == "release" and rng.random() < 0.4 else f"f{rng.randrange(6)}"
        rows.append((f"r{rng.randrange(2)}", f"a{rng.randrange(4)}", file, f"t{k}", kind, first + k * rng.choice([20, 90, 130]) // 2, first + k))
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_stream(spark, tmp_path, seed):
    """In batches, as a registry does it; the state read back as a table holds what is held."""
    rng = random.Random(seed)
    events = sorted(some(rng, 60), key=lambda e: (e[5], e[6]))
    for k in range(3):  # a file each
        spark.createDataFrame(events[k * 20 : k * 20 + 20], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = holds.reservations(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    want, held = plain(events)
    assert got(spark.read.parquet(str(tmp_path / "out")).select("repo", "ts", "kind", "file", "agent", "holder", "granted")) == want
    last = max(e[5] for e in events)
    alive = {(r.repo, r.file): (r.agent, r.task, r.taken) for r in holds.table(spark, str(tmp_path / "log")).collect() if last - r.taken < 600}
    assert alive == {k: h for k, h in held.items() if last - h[2] < 600}


def test_restart(spark, tmp_path):
    """From an old snapshot: expired holds are dropped, stamps of the future are those of now, heartbeats reach restored holds."""
    start = spark.createDataFrame([("r0", "f0", "a0", "t", 500), ("r0", "f1", "a1", "t", 399), ("r0", "f2", "a0", "t", 5000), ("r1", "f0", "a2", "t", 900)], holds.HOLDS)
    events = [("r0", "a0", None, None, "heartbeat", 1050, 0), ("r0", "a3", "f0", "n", "reserve", 1649, 1), ("r0", "a3", "f1", "n", "reserve", 1001, 2), ("r0", "a3", "f2", "n", "reserve", 1650, 3), ("r1", "a3", "f0", "n", "reserve", 1499, 4), ("r1", "a2", None, None, "release", 1499, 5), ("r1", "a3", "f0", "n", "reserve", 1499, 6)]
    spark.createDataFrame(events, SCHEMA).write.parquet(str(tmp_path / "in"))
    out = feeds.table_run(holds.reservations(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), start=start, now=1000))
    held = {("r0", "f0"): ("a0", "t", 500), ("r0", "f2"): ("a0", "t", 1000), ("r1", "f0"): ("a2", "t", 900)}
    assert got(out) == plain(events, held=held)[0]


def test_steps(spark, tmp_path):
    """Strictly less than ttl; a heartbeat renews; a release frees."""
    steps = [("a", "f", "reserve", 0), ("b", "f", "reserve", 10), ("a", None, "heartbeat", 500), ("b", "f", "reserve", 1099), ("b", "f", "reserve", 1100), ("b", None, "release", 1101), ("a", "f", "reserve", 1102)]
    spark.createDataFrame([("r", a, f, "t", kind, ts, k) for k, (a, f, kind, ts) in enumerate(steps)], SCHEMA).write.parquet(str(tmp_path / "in"))
    out = feeds.table_run(holds.reservations(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))).collect()
    assert sorted((r.ts, r.holder or "", r.granted) for r in out) == [(0, "a", True), (10, "a", False), (500, "a", True), (1099, "a", False), (1100, "b", True), (1101, "", True), (1102, "a", True)]


def test_live(spark, tmp_path):
    """With timers, which keep a query running: the same results while the clock stands before the expiry, and the state gone behind it."""
    events = [("r0", "a0", "f0", "t", "reserve", 0, 0), ("r0", "a1", "f0", "t", "reserve", 1, 1), ("r0", "a0", None, None, "heartbeat", 2, 2)]
    spark.createDataFrame(events, SCHEMA).write.parquet(str(tmp_path / "in"))
    log = str(tmp_path / "log")
    q = holds.reservations(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ttl=3, live=True).writeStream.format("memory").queryName("live_holds").option("checkpointLocation", log).start()
    began = time.time()
    try:
        while time.time() - began < 80 and (spark.table("live_holds").count() < 3 or len(q.recentProgress) < 3 or holds.table(spark, log).count()):
            time.sleep(2)
    finally:
        q.stop()
    assert got(spark.table("live_holds").select("repo", "ts", "kind", "file", "agent", "holder", "granted")) == plain(events)[0]
    assert holds.table(spark, log).count() == 0
