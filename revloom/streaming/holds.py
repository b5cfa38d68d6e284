"""Reservations as a stateful stream, one key for each file of a repository.

events(repo, agent, file, task, kind, ts, seq): kind reserve, heartbeat (all holds of the agent), release (of a file, or of all where file is null). A heartbeat names no file, so a first operator, keyed by agent, keeps the files that an agent
has asked for, with the last sign of life for each, and sends heartbeats and releases on to those of them that may still be held. The second operator, keyed by file, keeps one hold. So no state and no group is larger than one agent's files or
one file's events of a batch.

A hold lives while now - taken < ttl, now being the time of the event that looks at it; an event's stamp counts as no earlier than what its file has seen. Events of a batch count in order of their time and seq. With live=True, for a query that runs on, time is the
wall clock as well: a timer of ttl seconds clears the state of a file or an agent that has had no sign of life since (by then it is expired anyway). Otherwise what is expired goes with the next event of its key, or at a restart.

Holds are persisted with the state of each batch, which Spark commits as one; table() reads them back, and a new query takes such a table, however old, as its initial state (SNK-24, STR-10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import Row

from ..functions import text as T
from ..operators.coordination import TTL

EVENT = "repo string, file string, agent string, task string, kind string, ts long, seq long"
OUT = "repo string, ts long, kind string, file string, agent string, holder string, granted boolean"
HOLDS = "repo string, file string, agent string, task string, taken long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows):
    return sorted(rows, key=lambda r: (r.ts, r.seq))


class _Timed(StatefulProcessor):
    """Clears a key's state ttl seconds after its last event, where time is the wall clock."""

    def __init__(self, ttl: int, live: bool, now: int | None = None):
        self.ttl, self.live, self.now = ttl, live, now

    def _wake(self, times) -> None:
        if self.live:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + 1000 * self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class Agents(_Timed):
    """Keyed by (repo, agent): sends what an agent says about all of its files to each of them (STR-07)."""

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getMapState("files", "file string", "last long")

    def handleInputRows(self, key, rows, timerValues):
        repo, agent = key
        out = []
        for r in _in_order(rows):
            if r.kind == "reserve":
                if r.file is not None:
                    self.state.updateValue((r.file,), (r.ts,))
                    out.append(r.asDict())
            elif r.kind == "release" and r.file is not None:
                out.append(r.asDict())
            elif r.kind in ("heartbeat", "release"):
                for (file,), (last,) in list(self.state.iterator()):
                    if r.kind == "release" or not r.ts - last < self.ttl:
                        self.state.removeKey((file,))
                    else:
                        self.state.updateValue((file,), (max(last, r.ts),))
                    if r.ts - last < self.ttl:
                        out.append(r.asDict() | {"file": file})
        self._wake(timerValues)
        return iter([Row(**{c: x.get(c) for c in ("repo", "file", "agent", "task", "kind", "ts", "seq")}) for x in out])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        taken = initialState.taken if self.now is None else min(initialState.taken, self.now)
        if self.now is None or self.now - taken < self.ttl:
            self.state.updateValue((initialState.file,), (taken,))


class Files(_Timed):
    """Keyed by (repo, file): the hold of a file (STR-06, STR-08, STR-09)."""

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("hold", "agent string, task string, taken long, seen long")

    def handleInputRows(self, key, rows, timerValues):
        repo, file = key
        agent, task, taken, seen = self.state.get() if self.state.exists() else (None, None, None, None)
        out = []
        for r in _in_order(rows):
            seen = r.ts if seen is None else max(seen, r.ts)
            if agent is not None and not seen - taken < self.ttl:
                agent = None
            mine = agent == r.agent
            if r.kind == "reserve":
                free = agent is None or mine
                if free:
                    agent, task, taken = r.agent, r.task, seen
                out.append((seen, r.kind, r.agent, agent, free))
            elif mine:
                if r.kind == "heartbeat":
                    taken = seen
                else:
                    agent = None
                out.append((seen, r.kind, r.agent, agent, True))
        if agent is None:
            self.state.clear()
        else:
            self.state.update((agent, task, taken, seen))
        self._wake(timerValues)
        return iter([Row(repo=repo, ts=ts, kind=kind, file=file, agent=who, holder=holder, granted=granted) for ts, kind, who, holder, granted in out])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        now = self.now
        taken = initialState.taken if now is None else min(initialState.taken, now)
        if (now is None or now - taken < self.ttl) and not self.state.exists():
            self.state.update((initialState.agent, initialState.task, taken, taken))


def reservations(events: DataFrame, ttl: int = TTL, start: DataFrame | None = None, now: int | None = None, live: bool = False) -> DataFrame:
    """The stream of what each event did: repo, ts, kind, file, agent, holder, granted. start(repo, file, agent, task, taken): holds to begin with, of which those that are expired at `now` are dropped and stamps beyond it count as it. seq orders
    events of one time; without such a column, equal times keep no order."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    x = (events if "seq" in events.columns else events.withColumn("seq", F.lit(0).cast("long"))).select("repo", "file", "agent", "task", "kind", "ts", "seq")
    mode = "ProcessingTime" if live else "None"
    by_agent = None if start is None else start.groupBy("repo", "agent")
    by_file = None if start is None else start.groupBy("repo", "file")
    sent = x.groupBy("repo", "agent").transformWithState(Agents(ttl, live, now), EVENT, "append", mode, initialState=by_agent)
    return sent.groupBy("repo", "file").transformWithState(Files(ttl, live, now), OUT, "append", mode, initialState=by_file)


def table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The holds that a query's last committed batch has left: repo, file, agent, task, taken, the expired ones of quiet files included (SNK-24)."""
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "hold").load(checkpoint)
    return state.select("key.repo", "key.file", "value.agent", "value.task", "value.taken")


def from_events(raw: DataFrame) -> DataFrame:
    """The supplied events as reservation events: views reserve, clicks are heartbeats, purchases release; every sixteenth user works in one repository."""
    kind = F.when(F.col("event_type") == "view", "reserve").when(F.col("event_type") == "click", "heartbeat").when(F.col("event_type") == "purchase", "release")
    file = F.when(kind != "heartbeat", F.get_json_object("props", "$.k"))
    return raw.select(F.concat(F.lit("repo"), F.col("user_id") % 16).alias("repo"), F.col("user_id").cast("string").alias("agent"), file.alias("file"), F.col("event_id").cast("string").alias("task"), kind.alias("kind"), T.epoch_seconds("ts").alias("ts"), F.col("event_id").alias("seq")).where("kind is not null")
