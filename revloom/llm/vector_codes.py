"""Vector code compression: product quantisation in integers, with a vantage-point tree over the entries of each part position.

A tree node holds an entry as its vantage point; the entries within the median distance of it are inside, the others outside. A search goes down branch and bound: all parts of a batch are looked up at once, and a branch is
entered by those parts that, by the triangle inequality, may have an entry there as near as their best so far. Distances between parts and entries are integers, compared as such; only the bounds are floats. They
are rounded so that they err to the side of a visit (inner radii up, outer ones down, and a slack beyond all rounding of the roots), and a branch whose bound equals the best is visited too, since an equally near entry of a
lower index may be there. So the entry found is the one that a scan of all entries finds.

Each round, every task sums the parts of each entry, by position; Spark adds these sums, and parts x entries x width numbers come to the driver, whatever the number of rows. Rows are read again in each round and in the
last assignment.

Defined results: rows are dropped only as the contract says (null vectors, null or non-finite components). Vectors of different lengths, or of one that 16 doesn't divide, count as followed by zeros up to the longest one's
length, rounded up. With fewer than 64 vec_ids there are fewer entries. A null vec_id starts no entry; where rows repeat one of the first vec_ids, the smallest vector starts the entry; all rows are
coded and count in sums. Components of any size are exact: integers beyond 2^20 are computed as Python's. An error beyond 64 bits is 2^63 - 1. An empty table gives no rows. Only the three named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 4
SAFE = 1 << 20
LIMB = 10**30
TOP = (1 << 63) - 1


def integers(vectors: list, width: int) -> np.ndarray:
    """floor(256 x) of all components, padded with zeros to `width`: 64-bit integers, or Python's where one is beyond SAFE."""
    x = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        x[k, : len(v)] = v
    y = np.floor(x * SCALE)
    if not len(y) or np.abs(y).max() < SAFE:
        return y.astype(np.int64)
    return np.array([[int(b) if math.isfinite(b) else int(a) * SCALE for a, b in zip(r, s, strict=True)] for r, s in zip(x.tolist(), y.tolist(), strict=True)], object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=1)


def fits(*arrays: np.ndarray) -> bool:
    return all(a.dtype != object for a in arrays)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Tree:
    """A vantage-point tree over entries (rows of integers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries if not len(entries) or max(abs(int(entries.max())), abs(int(entries.min()))) >= SAFE else entries.astype(np.int64)
        self.node = self._grow(list(range(len(entries))))

    def _grow(self, own: list[int]):
        if len(own) <= LEAF:
            return own
        # the entry farthest from the first is at the rim, which splits the others well
        far = own[int(np.argmax(root(squared(self.entries[own], self.entries[own[0]]))))]
        rest = [k for k in own if k != far]
        d = root(squared(self.entries[rest], self.entries[far]))
        middle = float(np.sort(d)[(len(d) - 1) // 2])
        inside, outside = [k for k, x in zip(rest, d, strict=True) if x <= middle], [k for k, x in zip(rest, d, strict=True) if x > middle]
        inner = np.nextafter(d[d <= middle].max(), np.inf)
        outer = np.nextafter(d[d > middle].min(), 0) if outside else np.inf
        return far, middle, float(inner), float(outer), self._grow(inside), self._grow(outside)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q the nearest entry, of equally near ones the first, and its squared distance."""
        entries = self.entries
        if not fits(q, entries):
            q, entries = q.astype(object), entries.astype(object)
        best, index = np.full(len(q), -1, q.dtype), np.full(len(q), -1)

        def compare(k: int, rows: np.ndarray) -> np.ndarray:
            d = squared(q[rows], entries[k])
            had = best[rows]
            better = (index[rows] < 0) | (d < had) | ((d == had) & (k < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], k
            return d

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, list):
                for k in node:
                    compare(k, rows)
                return
            point, middle, inner, outer, inside, outside = node
            d = root(compare(point, rows))
            near = d <= middle
            visit(inside, rows[near])
            visit(outside, rows[~near])
            so_far = root(best[rows])
            slack = (d + so_far + inner) * 1e-9
            visit(outside, rows[near & (outer - d <= so_far + slack)])
            visit(inside, rows[~near & (d - inner <= so_far + slack)])

        visit(self.node, np.arange(len(q)))
        return index, best


def assign(trees: list[Tree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each part of each row, and the rows' squared distances together."""
    size = x.shape[1] // len(trees)
    found = [t.nearest(x[:, k * size : (k + 1) * size]) for k, t in enumerate(trees)]
    return np.column_stack([i for i, _ in found]), sum((d for _, d in found[1:]), found[0][1])


def sums(trees: list[Tree], width: int):
    """For mapInArrow over vectors: a task's sums by part, entry and place, with counts; each sum as two decimals."""
    size = width // len(trees)

    def run(batches):
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            if not len(b):
                continue
            x = integers(b.column(0).to_pylist(), width)
            found, _ = assign(trees, x)
            for p in range(len(trees)):
                own = x[:, p * size : (p + 1) * size]
                order = np.argsort(found[:, p], kind="stable")
                entry = found[order, p]
                first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
                each = np.add.reduceat(own[order], first, axis=0)
                for k, n, s in zip(entry[first].tolist(), np.diff([*first, len(entry)]).tolist(), each.tolist(), strict=True):
                    at = total.setdefault((p, k), [0, [0] * size])
                    at[0] += n
                    at[1] = [a + b for a, b in zip(at[1], s, strict=True)]
        rows = [(p, k, c, n, v) for (p, k), (n, s) in total.items() for c, v in enumerate(s)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0))
        columns = zip(*((p, k, c, n, Decimal(v // LIMB), Decimal(v % LIMB)) for p, k, c, n, v in rows), strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True)], names=["part", "entry", "place", "n", "high", "low"])

    return run


def codebooks(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Each part position's entries after all rounds."""
    first = kept.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    books, size = integers([r["v"] for r in first], width), width // parts
    books = [books[:, p * size : (p + 1) * size].astype(object) for p in range(parts)]
    for _ in range(rounds):
        if not len(books[0]):
            break
        trees = [Tree(b) for b in books]
        got = kept.select("v").mapInArrow(sums(trees, width), "part int, entry int, place int, n long, high decimal(38, 0), low decimal(38, 0)")
        for r in got.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
            books[r["part"]][r["entry"], r["place"]] = (int(r["high"]) * LIMB + int(r["low"])) // r["n"]
    return books


def compress(rows: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = written(rows.where(F.col(vector).isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).cast("array<double>").alias("v")), "vectors")
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(-(-longest // parts), 1) * parts
    books = codebooks(kept, width, parts, entries, rounds)
    said = hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()
    if not len(books[0]):  # no vec_id at all: one entry of zeros
        books = [np.zeros((1, width // parts), object)] * parts
    trees = [Tree(b) for b in books]

    def code(batches):
        for b in batches:
            if len(b):
                found, error = assign(trees, integers(b.column(2).to_pylist(), width))
                said = ["".join(f"{k:02x}" for k in r) for r in found.tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array([min(x, TOP) for x in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    coded = written(kept.mapInArrow(code, f"vec_id long, label {kind}, code string, error long").withColumn("own", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "coded")
    by_label = coded.groupBy("own").agg(F.least(F.sum(F.col("error").cast("decimal(38, 0)")), F.lit(TOP).cast("decimal(38, 0)")).cast("long").alias("label_error"))
    return salted_join(coded, by_label, ["own"]).select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _rounds() -> str:
    """The two rounds and the last assignment of ORACLE."""
    d = "list_sum(list_transform(range(1, size + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))"
    near = f"near{{k}} AS MATERIALIZED (SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT row, part, entry, {d} AS d FROM parts JOIN book{{k}} USING (part)) GROUP BY row, part)"
    book = """means{k} AS (SELECT part, entry, i, (s - ((s % n) + n) % n) // n AS v FROM (SELECT part, near{k}.entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{k} JOIN parts USING (row, part), (SELECT unnest(range(1, max(size) + 1)) AS i FROM parts) GROUP BY ALL)),
book{next} AS MATERIALIZED (SELECT book{k}.part, book{k}.entry, coalesce(m.e, book{k}.e) AS e FROM book{k} LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS e FROM means{k} GROUP BY ALL) m USING (part, entry))"""
    return ",\n".join([near.format(k=0), book.format(k=0, next=1), near.format(k=1), book.format(k=1, next=2), near.format(k=2)])


ORACLE = f"""
WITH kept AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, vec_id, part, len(v) // 16 AS size, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM (SELECT *, unnest(range(16)) AS part FROM kept)),
book0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS e FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_rounds()},
coded AS (SELECT row, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256 FROM coded JOIN kept USING (row)
"""
