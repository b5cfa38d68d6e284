"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Every document gives a vector of statistics of its text (never its id, language, source or labels). Standardised by the labelled training rows,
it is mapped to `features` random cosines, which approximate a Gaussian kernel. Each partition sums its part of the normal equations
(features x features numbers, whatever its rows); sums meet in a tree of few rows a task, and the driver solves one system. Raw scores are
calibrated by isotonic regression on a histogram of at most 2 x BINS + 1 cells.

Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0; labels that are null are left out, several of one doc_id are averaged.

Defined results: a null text counts as an empty one, and gets a score like any text. A null doc_id has no label, is scored, and is not held out.
Repeated rows get equal scores. With no usable label, or none of one class, every score is the mean label (0.5 without any). Only doc_id, text and the labels' doc_id and
quality are read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, total, written

FEATURES, RIDGE, WIDTH, SEED, BINS, CUT = 256, 1e-3, 0.8, 20, 1000, 0.3

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 space, 4 stop, 5 comma, 6 quote and dash, 7 other sign, 8 upper case, 9 beyond ASCII
for _c in range(256):
    _x = chr(_c)
    _KIND[_c] = 9 if _c > 127 else 8 if _x.isupper() else 1 if _x.isalpha() else 2 if _x.isdigit() else 3 if _x.isspace() else 4 if _x in ".!?" else 5 if _x in ",;:" else 6 if _x in "'\"-()" else 7
N_STATS = 29


def statistics(text: bytes) -> list[float]:
    """N_STATS numbers on the whole text, each of them mild in range."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    raw = np.frombuffer(text, np.uint8)
    kind = np.bincount(_KIND[raw], minlength=10) / n
    low = text.lower()
    words = low.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    same = sum(map(lambda a, b: a == b, words, words[1:])) / m
    pairs = len(set(zip(words, words[1:], strict=False))) / m
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / m
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"', b":") for x in lines) / k
    line_len = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1, np.int64)
    size = len(zlib.compress(text, 1)) / n
    bytes_seen = np.bincount(raw, minlength=256)
    p = bytes_seen[bytes_seen > 0] / n
    return [
        np.log1p(n), np.log1p(m), lengths.mean() / 4, min(lengths.std(), 40) / 4, np.log1p(lengths.max()), *kind[1:10], len(counts) / m, np.sqrt(len(counts)) / np.sqrt(m) * np.log1p(m) / 8,
        top[0] / m if top else 0, sum(top) / m, same, pairs, triples, len(set(lines)) / k, ends, np.log1p(line_len.mean()), np.log1p(k), size, -(p * np.log2(p)).sum(), float((lengths <= 3).mean()), float((lengths > 14).mean()),
    ]


def stats_of(batches):
    for b in batches:
        rows = np.array([statistics(t or b"") for t in b.column(1).to_pylist()], np.float64).reshape(-1, N_STATS)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "stats"])


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(batches):
    out = None
    for b in batches:
        if len(b):
            x, y = matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
            new = np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)])
            out = new if out is None else out + new
    return out


class Cosines:
    """The random features: sqrt(2 / D) cos(z W + b) on standardised statistics z, kept within 5 deviations."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, features: int):
        rng = np.random.default_rng(SEED)
        self.mean, self.dev = mean, dev
        self.w = rng.normal(0, WIDTH / np.sqrt(len(mean)), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.dev, -5, 5)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z / 10, np.ones((len(x), 1))], axis=1)


def normal_equations(cosines: Cosines):
    def partial(batches):
        out = None
        for b in batches:
            if len(b):
                p, y = cosines(matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False)
                new = np.concatenate([(p.T @ p).ravel(), p.T @ y])
                out = new if out is None else out + new
        return out

    return partial


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x with mean y and weight n: centres and values of the blocks, values rising."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], top, strict=True)]
    got = np.array(blocks)
    return got[:, 0] / got[:, 2], got[:, 1] / got[:, 2]


def stats(docs: DataFrame) -> DataFrame:
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(stats_of, "doc_id long, stats array<double>"), "stats")


def fit(rows: DataFrame, labels: DataFrame, features: int = FEATURES) -> tuple:
    """The model of the statistics' rows that have labels and aren't held out."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").cast("double").alias("y"))
    train = written(rows.where(~held_out(F.col("doc_id"), 5)).join(marks, "doc_id").select("stats", "y"), "train")
    m = total(train, moments)
    mean_y = m[1] / m[0] if m is not None else 0.5
    if m is None or not 0 < mean_y < 1:
        return None, None, None, [mean_y]
    n, mean = m[0], m[2 : 2 + N_STATS] / m[0]
    dev = np.sqrt(np.maximum(m[2 + N_STATS :] / n - mean**2, 1e-8))
    cosines = Cosines(mean, dev, features)
    t = total(train, normal_equations(cosines))
    d = features + N_STATS + 1
    weights = np.linalg.solve(t[: d * d].reshape(d, d) + RIDGE * n * np.eye(d) / d, t[d * d :])

    def raw(batches):
        for b in batches:
            s = cosines(matrix(b.column(0))) @ weights if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64()), b.column(1)], names=["s", "y"])

    cell = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("s"))) * (BINS * 2 / 3)).cast("int")
    hist = train.mapInArrow(raw, "s double, y double").groupBy(cell.alias("cell")).agg(F.avg("s").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("cell").collect()
    xs, ys = isotonic(*(np.array([r[k] for r in hist], np.float64) for k in ("x", "y", "n")))
    return cosines, weights, xs, np.clip(ys, 0, 1)


def values(model: tuple, x: np.ndarray) -> np.ndarray:
    cosines, weights, xs, ys = model
    if cosines is None:
        return np.full(len(x), ys[0])
    return np.interp(cosines(x) @ weights, xs, ys) if len(x) else np.zeros(0)


def score(docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = stats(docs)
    model = fit(rows, labels, features)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values(model, matrix(b.column(1)) if len(b) else np.zeros((0, N_STATS))), pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is at least CUT, with all their columns. Statistics are computed anew, which is cheaper than to shuffle texts to their scores."""
    model = fit(stats(docs), labels)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            x = np.array([statistics(t or b"") for t in texts], np.float64).reshape(-1, N_STATS)
            yield b.filter(pa.array(values(model, x) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
