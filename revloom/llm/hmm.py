"""LM scoring: a hidden Markov model of word classes, with words drawn from their class.

A word's class is a fixed function of it: words of up to four bytes fall into CLASSES by their hash, longer ones by their last three bytes; the end of a text is a class of its
own. A latent state emits a class and moves on; a class emits a word by its smoothed count. The probability of a text is therefore exact: the scaled
forward recursion over its classes, times its words' probabilities within their classes; unknown words of a class share one more smoothed count.

Training covers all training texts, whole. Word counts are summed for each chunk of documents before they are shuffled, and a chunk gets the corpus counts of its own words only, so
that no task ever holds the vocabulary; a word that nearly all chunks hold is dealt over many tasks. Baum-Welch starts from a model fitted to at most START_DOCS texts of at most START_BYTES together (a
starting point only) and then makes passes over the whole corpus until the likelihood gains less than GAIN of itself, PASSES at most;
each partition sums its expected counts, and the sums (STATES x CLASSES numbers, whatever the corpus) meet in a tree.

Defined results: a null or empty text is its end token alone. Rows whose crc32(doc_id as text) mod 10 is 0 are held out; a null doc_id is not. Repeated rows are trained on as often as they occur
and get equal scores. Without training rows every token is unknown. An empty table gives no rows. A long text is one sequence in training and scoring. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, salted_join, table, total, written
from .tokens import Words, mix

STATES, CLASSES, PASSES, GAIN, ALPHA = 12, 4096, 2, 0.002, 0.1
START_DOCS, START_BYTES, START_PASSES = 1500, 8 << 20, 12
CHUNK_BYTES, CHUNK_DOCS, GROUP = 8 << 20, 2500, 500_000
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end token's hash


def classes(words: Words) -> np.ndarray:
    short = words.lengths <= 4
    return (np.where(short, words.hashes, mix(words.last.astype(np.uint64) + np.uint64(1 << 40))) % np.uint64(CLASSES - 1)).astype(np.int64) + 1


def with_ends(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of all tokens, ends included, and where each text begins."""
    w = Words(texts)
    at = w.at + np.arange(len(w.at))
    h, c = np.full(at[-1], END, np.uint64), np.zeros(at[-1], np.int64)
    where = np.ones(at[-1], bool)
    where[at[1:] - 1] = False
    h[where], c[where] = w.hashes, classes(w)
    return h, c, at


def forward(obs, starts, lengths, pi, move, emit, keep: bool):
    """The scaled recursion over sequences (starts and lengths into obs), longest first: log10 of each one's probability; with keep, also what backward needs."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    active = len(s) - np.searchsorted(np.sort(lengths), np.arange(n[0] if len(n) else 0), "right")
    logs = np.zeros(len(s))
    alphas, scales, a = [], [], None
    for t, k in enumerate(active):
        a = emit[obs[s[:k] + t]] * (pi[None, :] if t == 0 else a[:k] @ move)
        c = a.sum(axis=1)
        a /= c[:, None]
        logs[:k] += np.log10(c)
        if keep:
            alphas.append(a)
            scales.append(c)
    out = np.empty(len(s))
    out[order] = logs
    return (out, order, active, alphas, scales) if keep else out


def expected(obs, starts, lengths, pi, move, emit):
    """Expected counts of starts, moves and emissions, and log10 of all sequences' probability."""
    logs, order, active, alphas, scales = forward(obs, starts, lengths, pi, move, emit, True)
    s = starts[order]
    first, moves, emissions = np.zeros_like(pi), np.zeros_like(move), np.zeros((CLASSES, len(pi)))
    gammas, places = [], []
    b = None
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        full = np.ones((k, len(pi)), np.float32)
        if b is not None:
            nxt = emit[obs[s[: len(b)] + t + 1]] * b / scales[t + 1][:, None]
            full[: len(b)] = nxt @ move.T
            moves += alphas[t][: len(b)].T @ nxt
        b = full
        gammas.append(alphas[t] * b)
        places.append(obs[s[:k] + t])
        if t == 0:
            first += gammas[-1].sum(axis=0)
    g, o = np.concatenate(gammas), np.concatenate(places)
    for k in range(len(pi)):
        emissions[:, k] = np.bincount(o, weights=g[:, k], minlength=CLASSES)
    return first, moves * move, emissions, logs.sum()


def grouped(batches, column: int, size: int):
    """Lists of texts of about `size` bytes."""
    got, n = [], 0
    for b in batches:
        for t in b.column(column).to_pylist():
            got.append(t)
            n += len(t or b"")
            if n >= size:
                yield got
                got, n = [], 0
    if got:
        yield got


class Model:
    def __init__(self, pi, move, emit):
        self.pi, self.move, self.emit = pi.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)

    @staticmethod
    def of(first, moves, emissions) -> Model:
        """The re-estimated model; emissions lean on those of all states together."""
        k = len(first)
        overall = (emissions.sum(axis=1) + 0.5) / (emissions.sum() + 0.5 * CLASSES)
        emit = (emissions + 20 * overall[:, None]) / (emissions.sum(axis=0) + 20)
        return Model((first + 0.1) / (first.sum() + 0.1 * k), (moves + 0.1) / (moves.sum(axis=1, keepdims=True) + 0.1 * k), emit)

    @staticmethod
    def start(texts) -> Model:
        """A model of a few texts, from states that lean to some of the texts each."""
        rng = np.random.default_rng(11)
        _, obs, at = with_ends(texts)
        k = STATES
        which = np.repeat(rng.integers(0, k, len(texts)), np.diff(at))
        emissions = np.stack([np.bincount(obs[which == i], minlength=CLASSES) for i in range(k)], axis=1).astype(float)
        model = Model.of(np.ones(k), np.eye(k) * 20 + 1, emissions)
        for _ in range(START_PASSES):
            model = Model.of(*expected(obs, at[:-1], np.diff(at), model.pi, model.move, model.emit)[:3])
        return model

    def counts(self, batches):
        """The expected counts of a partition of (text), as one array."""
        out = None
        for texts in grouped(batches, 0, 6 * GROUP):
            _, obs, at = with_ends(texts)
            first, moves, emissions, likelihood = expected(obs, at[:-1], np.diff(at), self.pi, self.move, self.emit)
            new = np.concatenate([first, moves.ravel(), emissions.ravel(), [likelihood]])
            out = new if out is None else out + new
        return out

    def after(self, sums: np.ndarray) -> Model:
        k = len(self.pi)
        return Model.of(sums[:k], sums[k : k + k * k].reshape(k, k), sums[k + k * k : -1].reshape(CLASSES, k))


def chunk_counts(batches):
    """(chunk, h, class, c): the distinct tokens of each chunk's part in this task with their training counts."""

    def rows(chunk, texts, held):
        h, cls, at = with_ends(texts)
        train = np.repeat(~np.array(held, bool), np.diff(at))
        order = np.argsort(h, kind="stable")
        h, cls, train = h[order], cls[order], train[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        u, c = h[first], np.add.reduceat(train.astype(np.int64), first)
        for k in range(0, len(u), 100_000):
            n = len(u[k : k + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(u[k : k + n].view(np.int64)), pa.array(cls[first[k : k + n]].astype(np.int32)), pa.array(c[k : k + n])], names=["chunk", "h", "cls", "c"])

    got: dict[int, tuple[list, list]] = {}
    size = 0
    for b in batches:
        for chunk, held, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            texts, helds = got.setdefault(chunk, ([], []))
            texts.append(text)
            helds.append(held)
            size += len(text or b"")
        if size >= CHUNK_BYTES * 4:
            for chunk, (texts, helds) in got.items():
                yield from rows(chunk, texts, helds)
            got, size = {}, 0
    for chunk, (texts, helds) in got.items():
        yield from rows(chunk, texts, helds)


def chunked(docs: DataFrame) -> DataFrame:
    """docs with a chunk: rows of one part of an input file (about CHUNK_BYTES of it), or, if docs come from elsewhere, of one hash class of CHUNK_DOCS rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.input_file_block_length().alias("length"))
    n = max(1, -(-docs.count() // CHUNK_DOCS))
    parts = F.when(F.col("length") > 0, F.ceil(F.col("length") / CHUNK_BYTES)).otherwise(F.lit(n))
    return rows.select(F.xxhash64("file", "start", F.pmod(F.xxhash64("doc_id", "text"), parts)).alias("chunk"), held_out(F.col("doc_id"), 10).alias("held_out"), "doc_id", "text")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scorer(model: Model, n_all: int, v_all: int, class_n: np.ndarray, class_v: np.ndarray):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not docs.num_rows:
            return kinds.empty_table()
        known = counts["h"].combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.argsort(known)
        known, c_of = known[order], counts["c"].combine_chunks().to_numpy(zero_copy_only=False)[order]
        ids, held = docs["doc_id"].combine_chunks(), docs["held_out"].combine_chunks()
        texts = docs["text"]
        out = {k: [] for k in ("n", "known", "base", "score")}
        done = 0
        sizes = np.cumsum([len(t or b"") for t in texts.to_pylist()]) if docs.num_rows else np.zeros(0)
        while done < docs.num_rows:  # groups of about GROUP tokens
            upto = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + 6 * GROUP, "right")))
            part = texts.slice(done, upto - done).to_pylist()
            done = upto
            h, obs, at = with_ends(part)
            k = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            c = np.where(known[k] == h, c_of[k], 0) if len(known) else np.zeros(len(h), np.int64)
            n = np.diff(at)
            sums = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731,B023
            out["n"].append(n)
            out["known"].append(sums((c > 0).astype(np.int64)))
            out["base"].append(sums(np.log10((c + ALPHA) / (n_all + ALPHA * (v_all + 1)))))
            inside = np.log10((c + ALPHA) / (class_n[obs] + ALPHA * (class_v[obs] + 1)))
            inside[at[1:] - 1] = 0  # the end is the only token of its class
            out["score"].append(forward(obs, at[:-1], n, model.pi, model.move, model.emit, False) + sums(inside))
        got = {k: np.concatenate(v) for k, v in out.items()}
        return pa.Table.from_arrays([ids, held, pa.array(got["n"]), pa.array(got["known"]), pa.array(np.full(len(ids), n_all, np.int64)), pa.array(got["base"]), pa.array(got["score"])], schema=kinds)

    return run


def start_texts(train: DataFrame) -> list[bytes | None]:
    """Texts to start from: those of the START_DOCS least hashes of doc_id, as far as they have START_BYTES together; a longer one is passed over."""
    keyed = train.select("text", F.xxhash64("doc_id", F.lit(3)).alias("k"))
    first = keyed.groupBy("k").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).orderBy("k").limit(START_DOCS).collect()  # START_DOCS pairs of numbers
    chosen, size = [], 0
    for r in first:
        if size + r["size"] <= START_BYTES:
            chosen.append(r["k"])
            size += r["size"]
    return [r["text"] for r in sorted(keyed.where(F.col("k").isin(chosen)).collect(), key=lambda r: (r["k"], r["text"] or b""))] if chosen else []


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = chunked(docs)
    each = written(rows.select("chunk", "held_out", "text").mapInArrow(chunk_counts, "chunk long, h long, cls int, c long"), "token_counts")
    totals = written(each.groupBy("h").agg(F.sum("c").alias("c"), F.min("cls").alias("cls"), F.count("*").alias("count")), "totals")
    class_n, class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in totals.where("c > 0").groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # at most CLASSES rows
        class_n[r["cls"]], class_v[r["cls"]] = r["n"], r["v"]
    train = docs.where(~held_out(F.col("doc_id"), 10)).select("doc_id", F.col("text").cast("binary").alias("text"))
    model, before = Model.start(start_texts(train) or [b""]), None
    for _ in range(PASSES):
        sums = total(train.select("text"), model.counts)
        if sums is None:
            break
        model, likelihood = model.after(sums), sums[-1]
        if before is not None and likelihood - before < GAIN * abs(before):
            break
        before = likelihood
    counts = salted_join(each.select("chunk", "h"), totals.select("h", "c"), ["h"], counts=totals)
    run = scorer(model, int(class_n.sum()), int(class_v.sum()), class_n, class_v)
    return rows.groupBy("chunk").cogroup(counts.select("chunk", "h", "c").groupBy("chunk")).applyInArrow(run, SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
