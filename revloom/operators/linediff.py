"""Line differences of text pairs, by an Arrow function over rows."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CELLS, CONTEXT = 4_000_000, 3
PAIRS = 256  # rows that Python holds as objects at a time; all rows pass


def split_lines(text: str) -> list[str]:
    got = text.split("\n")
    if got[-1] == "":
        got.pop()
    return [x[:-1] if x.endswith("\r") else x for x in got]


def edits(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """(tag, line of a, line of b) in order; tags ' ', '-', '+'. Common ends are set aside; the middle is aligned by a longest common subsequence, deletions before additions on ties, or, beyond CELLS cells, replaced as a whole."""
    lo, most = 0, min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < most - lo and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(" ", i, i) for i in range(lo)]
    x, y = a[lo : len(a) - tail], b[lo : len(b) - tail]
    m, n = len(x), len(y)
    i = j = 0
    both = set(x) & set(y) if m * n <= CELLS else set()
    kept = [s for s in x if s in both]
    if kept and len(kept) == len(both) and kept == [s for s in y if s in both]:  # what both sides have stands once and in one order: the only longest subsequence
        while i < m and j < n:
            if x[i] not in both:
                out.append(("-", lo + i, lo + j))
                i += 1
            elif y[j] not in both:
                out.append(("+", lo + i, lo + j))
                j += 1
            else:
                out.append((" ", lo + i, lo + j))
                i, j = i + 1, j + 1
    elif kept:
        ids: dict[str, int] = {}
        p, q = (np.array([ids.setdefault(s, len(ids)) for s in side]) for side in (x, y))
        best = np.zeros((m + 1, n + 1), np.int32)
        for r in range(m - 1, -1, -1):  # a row at a time: a match takes the diagonal, the rest is a running maximum from the right
            cell = np.where(q == p[r], best[r + 1, 1:] + 1, best[r + 1, :-1])
            best[r, :-1] = np.maximum.accumulate(cell[::-1])[::-1]
        p, q, best = p.tolist(), q.tolist(), best.tolist()
        while i < m and j < n:
            if p[i] == q[j]:
                out.append((" ", lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                out.append(("-", lo + i, lo + j))
                i += 1
            else:
                out.append(("+", lo + i, lo + j))
                j += 1
    out += [("-", lo + k, lo + j) for k in range(i, m)]
    out += [("+", lo + m, lo + k) for k in range(j, n)]
    return out + [(" ", len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


OPS = pa.list_(pa.struct([("at", pa.int32()), ("tag", pa.string()), ("old_line", pa.int32()), ("new_line", pa.int32()), ("text", pa.string())]))
OPS_SQL = "array<struct<at:int,tag:string,old_line:int,new_line:int,text:string>>"


def diff_one(old: str | None, new: str | None) -> list[dict]:
    """The whole listing of a pair: lines of both sides from 1. A missing side is empty; one with a NUL byte makes the pair binary, without lines."""
    if "\0" in (old or "") or "\0" in (new or ""):
        return []
    a, b = split_lines(old or ""), split_lines(new or "")
    return [{"at": k, "tag": tag, "old_line": i + 1, "new_line": j + 1, "text": b[j] if tag == "+" else a[i]} for k, (tag, i, j) in enumerate(edits(a, b))]


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, PAIRS):
            yield b.slice(at, PAIRS)


def _kept(df: DataFrame, also: tuple[str, ...]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in also)


def diff(pairs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """pairs(key string, old, new) -> (key, also.., ops) (F-18, F-19). Each row is diffed where it stands, without a shuffle; equal pairs that follow one another closely are diffed once."""
    k = 1 + len(also)

    def run(batches):
        for b in _slices(batches):
            once = cache(diff_one)
            ops = pa.array([once(x, y) for x, y in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist(), strict=True)], OPS)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], ops], names=[*b.schema.names[:k], "ops"])

    rows = pairs.select(F.col("key").cast("string").alias("key"), *also, F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new"))
    return rows.mapInArrow(run, f"key string, {_kept(pairs, also)}ops {OPS_SQL}")


def changed_in(files: DataFrame, also: tuple[str, ...]) -> DataFrame:
    """files(also.., old, new) -> (also.., at, side, line, symbol, text): changed lines, and the definition around each in the text of its side, in one pass without a shuffle (F-20, F-21, WIN-08)."""
    k = len(also)

    def one(old, new):
        sides = {"-": ("removed", split_lines(old or ""), "old_line"), "+": ("added", split_lines(new or ""), "new_line")}
        changed = [o for o in diff_one(old, new) if o["tag"] != " "]
        return [(o["at"], sides[o["tag"]][0], o[sides[o["tag"]][2]], enclosing(sides[o["tag"]][1], o[sides[o["tag"]][2]] - 1), o["text"]) for o in changed]

    def run(batches):
        for b in _slices(batches):
            once = cache(one)
            found = [once(x, y) for x, y in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist(), strict=True)]
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            columns = list(zip(*(r for f in found for r in f), strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in b.columns[:k]), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*b.schema.names[:k], "at", "side", "line", "symbol", "text"])

    return files.select(*also, F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new")).mapInArrow(run, f"{_kept(files, also)}at int, side string, line int, symbol string, text string")


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(key, at, side, line, text) of added and removed lines (F-20, F-21)."""
    x = diffs.select("key", F.explode("ops").alias("o")).where("o.tag <> ' '")
    return x.select("key", "o.at", F.when(F.col("o.tag") == "+", "added").otherwise("removed").alias("side"), F.when(F.col("o.tag") == "+", F.col("o.new_line")).otherwise(F.col("o.old_line")).alias("line"), "o.text")


def changed_text(diffs: DataFrame) -> DataFrame:
    """(key, text): the changed lines of both sides, each ended by a line break (F-22, X-39)."""
    lines = F.transform(F.filter("ops", lambda o: o["tag"] != " "), lambda o: F.concat(o["text"], F.lit("\n")))
    return diffs.select("key", F.array_join(lines, "").alias("text"))


def hunks(diffs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also.., hunk, old_start, old_len, new_start, new_len, lines): changes no more than 2 x CONTEXT unchanged lines apart share a hunk, with CONTEXT lines around (WIN-06, WIN-07, AGG-11). All inside the row's own array."""

    of = 1 + len(also)

    def run(batches):
        for b in _slices(batches):
            rows = []
            for key, ops in enumerate(b.column(of).to_pylist()):
                tags = np.array([o["tag"] for o in ops])
                at = np.flatnonzero(tags != " ") if len(tags) else tags
                if not len(at):
                    continue
                old = np.concatenate([[0], np.cumsum(tags != "+")])
                new = np.concatenate([[0], np.cumsum(tags != "-")])
                for h, run_ in enumerate(np.split(at, np.flatnonzero(np.diff(at) - 1 > 2 * CONTEXT) + 1)):
                    s, e = max(0, run_[0] - CONTEXT), min(len(ops), run_[-1] + CONTEXT + 1)
                    n_old, n_new = int(old[e] - old[s]), int(new[e] - new[s])
                    rows.append((key, h, int(old[s]) + (n_old > 0), n_old, int(new[s]) + (n_new > 0), n_new, [o["tag"] + o["text"] for o in ops[s:e]]))
            kinds = [*[pa.int32()] * 5, pa.list_(pa.string())]
            own = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(own) for c in b.columns[:of]), *(pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds))], names=[*b.schema.names[:of], "hunk", "old_start", "old_len", "new_start", "new_len", "lines"])

    return diffs.select("key", *also, "ops").mapInArrow(run, f"key string, {_kept(diffs, also)}hunk int, old_start int, old_len int, new_start int, new_len int, lines array<string>")


def counts(diffs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, added, deleted) (AGG-11)."""
    n = lambda tag: F.size(F.filter("ops", lambda o: o["tag"] == tag)).alias({"+": "added", "-": "deleted"}[tag])
    return diffs.select("key", *also, n("+"), n("-"))


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    definition = re.compile(rf"(?:(?:{'|'.join(re.escape(m) for m in T.MODIFIERS)}) \s*)*((?:{'|'.join(T.DEFINITIONS)}) )\s*(\w+)")
    return definition, re.compile(rf"\}}|(?:{'|'.join(T.CONTROL_WORDS)})(?!\w)")


def enclosing(lines: list[str], at: int) -> str | None:
    """The definition around a line by indentation, climbing through control blocks; none where another container is in between (WIN-08)."""
    definition, control = _patterns()
    depth = lambda s: len(s) - len(s.lstrip())
    if not 0 <= at < len(lines):
        return None
    limit = depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) >= limit:
            continue
        inner = line.lstrip()
        if m := definition.match(inner):
            return m[1] + m[2]
        if not control.match(inner):
            return None
        limit = depth(line)
    return None


def attribute(rows: DataFrame) -> DataFrame:
    """rows(key, content, at array<int>): lines from 1 -> (key, line, symbol) (WIN-08)."""

    def run(batches):
        for b in batches:
            keys, at, names = [], [], []
            for key, content, wanted in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                lines = split_lines(content or "")
                for k in wanted or []:
                    keys.append(key)
                    at.append(k)
                    names.append(enclosing(lines, k - 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(at, pa.int32()), pa.array(names, pa.string())], names=["key", "line", "symbol"])

    return rows.select(F.col("key").cast("string").alias("key"), "content", F.col("at").cast("array<int>").alias("at")).mapInArrow(run, "key string, line int, symbol string")


def innermost(lines: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """lines(file, line) with the innermost of ranges(file, name, start_line, end_line) around each (J-15). Ranges are cut into cells of `width` lines, so that the join is on equal keys and a file's lines meet only the ranges of their cell."""
    cell = lambda c: F.floor(c / width)
    cut = ranges.withColumn("cell", F.explode(F.sequence(cell(F.col("start_line")), cell(F.col("end_line")))))
    met = lines.withColumn("cell", cell(F.col("line"))).alias("l").join(cut.alias("r"), ["file", "cell"], "left").where("r.name is null or line between start_line and end_line")
    best = met.where("name is not null").groupBy("file", "line").agg(F.min_by(F.struct("name", "start_line", "end_line"), F.struct(F.col("end_line") - F.col("start_line"), "start_line", "name")).alias("r"))
    return lines.join(best.select("file", "line", F.col("r.name").alias("symbol")), ["file", "line"], "left")
