"""Line dedup with two Bloom filters.

A first pass hashes every line's key and sets it in a filter of keys seen once; a key found there already is set in the filter of keys seen twice.
Each task does so for its own rows; tasks' filters merge segment by segment (twice = either twice, or both once), so that a key in
two tasks is always in the merged "twice" filter. Filters have no false negatives. A second pass lets only lines whose keys are in
the "twice" filter through: these few are shuffled with their whole keys for an exact count of documents and the smallest doc_id.

The filter has 16 bits for each expected line, at most 2^30 (128 MB); beyond, more lines are suspected and shuffled, with the same result. A key that very many documents hold is dealt over many
tasks when its first document is joined back.

Defined results: a null or empty text is one empty line. A row with a null doc_id belongs to no document: its lines neither count nor drop.
Rows that repeat a doc_id are one document; each keeps or loses its own lines. An empty table gives no rows. Texts of any length are taken whole, in parts of batches cut by bytes. Only doc_id and text are
read; rewrite() keeps all other columns, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import bits_for, built, has_all, opened, places
from .common import salted_join, slices, table, written

STRIP = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    return line.strip(STRIP).lower()


def counts_as_line(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def line_hashes(texts, least: int):
    for text in texts:
        for line in (text or b"").split(b"\n"):
            key = line.strip(STRIP).lower()
            if counts_as_line(key, least):
                yield xxhash.xxh3_64_intdigest(key)


def suspects(filter_of, bits: int, least: int):
    def run(batches):
        twice = opened(filter_of)
        for b in (part for whole in batches for part in slices(whole, 2)):
            ids, where, keys, hashes = [], [], [], []
            for doc_id, th, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                seen = set()
                for line in (text or b"").split(b"\n"):
                    key = line.strip(STRIP).lower()
                    if key not in seen and counts_as_line(key, least):
                        seen.add(key)
                        ids.append(doc_id)
                        where.append(th)
                        keys.append(key)
                        hashes.append(xxhash.xxh3_64_intdigest(key))
            if not ids:
                continue
            k = np.flatnonzero(has_all(twice, places(np.array(hashes, np.uint64), bits)))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[i] for i in k], pa.int64()), "th": pa.array([where[i] for i in k], pa.int64()), "line_key": pa.array([keys[i] for i in k], pa.binary())})

    return run


def drops(docs: DataFrame, least: int = 10) -> DataFrame:
    """The keys that each document loses: doc_id, th (a hash of its text), keys array<binary>."""
    bits = bits_for(docs.count() * 10, 16)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    twice = built(rows.select("text"), lambda b: np.fromiter(line_hashes(b.column(0).to_pylist(), least), dtype=np.uint64), bits)
    found = written(rows.mapInArrow(suspects(twice, bits, least), "doc_id long, th long, line_key binary"), "suspects")
    first = found.groupBy("line_key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("line_key", "first_id")
    lost = salted_join(found, first, ["line_key"]).where("doc_id > first_id")
    return lost.groupBy("doc_id", "th").agg(F.collect_set("line_key").alias("keys"))


def apply_drops(batches):
    for b in (part for whole in batches for part in slices(whole, 1)):
        out = {k: [] for k in ("doc_id", "kept", "n_lines", "n_dropped", "kept_sha256")}
        for doc_id, text, keys in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            lines = (text or b"").split(b"\n")
            if keys:
                keys = set(keys)
                left = [x for x in lines if x.strip(STRIP).lower() not in keys]
                kept = b"\n".join(left)
            else:
                left, kept = lines, text or b""
            for k, v in zip(out, (doc_id, kept, len(lines), len(lines) - len(left), hashlib.sha256(kept).hexdigest()), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out["doc_id"], pa.int64()), "kept": pa.array(out["kept"], pa.binary()), "n_lines": pa.array(out["n_lines"], pa.int64()), "n_dropped": pa.array(out["n_dropped"], pa.int64()), "kept_sha256": out["kept_sha256"]})


def digest_only(batches):
    for b in apply_drops(batches):
        yield b.select(["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def joined(docs: DataFrame, lost: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th"))
    return rows.join(lost, ["doc_id", "th"], "left").select("doc_id", "text", "keys")


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """One row per document: doc_id, kept (the text left, as UTF-8 bytes), n_lines, n_dropped, kept_sha256."""
    return joined(docs, drops(docs, least)).mapInArrow(apply_drops, "doc_id long, kept binary, n_lines long, n_dropped long, kept_sha256 string")


def rewrite(docs: DataFrame, least: int = 10) -> DataFrame:
    """The documents with the text that is left, its n_chars, and all their other columns."""
    lost = drops(docs, least)
    own = "lost"
    while any(own in c.lower() for c in docs.columns):  # a name that no column of docs has
        own += "_"
    lost = lost.select(F.struct("doc_id", "th", "keys").alias(own))
    marked = docs.join(lost, (docs["doc_id"] == F.col(f"{own}.doc_id")) & (F.xxhash64(docs["text"]) == F.col(f"{own}.th")), "left").select(*(docs[c] for c in docs.columns), F.col(f"{own}.keys").alias(own))
    at, last = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for b in batches:
            texts = []
            for text, keys in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(last).to_pylist(), strict=True):
                if keys:
                    keys = set(keys)
                    text = b"\n".join(x for x in text.split(b"\n") if x.strip(STRIP).lower() not in keys)
                texts.append(text)
            yield b.select(list(range(last))).set_column(at, b.schema.field(at), pa.array(texts, pa.binary()).cast(b.schema.field(at).type))

    out = marked.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return joined(docs, drops(docs)).mapInArrow(digest_only, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH lines AS (SELECT doc_id, pos, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k0
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
keyed AS (SELECT doc_id, pos, line, translate(k0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
rep AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, rep.k IS NOT NULL AND keyed.doc_id > rep.first_id AS gone FROM keyed LEFT JOIN rep ON keyed.k = rep.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""
