"""Git repositories as tables: objects of loose files and packs, refs, commits, trees. Each file is read whole by one task."""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import trees

OBJECTS = "oid string, kind string, size long, payload binary"
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


def oid_of(kind: str, payload: bytes) -> str:
    return hashlib.sha1(f"{kind} {len(payload)}".encode() + b"\0" + payload).hexdigest()


def read_loose(data: bytes) -> tuple[str, bytes]:
    """A loose object; ValueError if its length isn't as said (SRC-12)."""
    raw = zlib.decompress(data)
    head, _, payload = raw.partition(b"\0")
    kind, _, size = head.decode().partition(" ")
    if kind not in KINDS.values() or int(size) != len(payload):
        raise ValueError("loose object")
    return kind, payload


def apply_delta(base: bytes, ops: bytes) -> bytes:
    """A pack's delta: copies by offset and size, literals by length (F-46)."""
    at, sizes = 0, []
    for _ in range(2):
        v = shift = 0
        while True:
            c = ops[at]
            at += 1
            v |= (c & 127) << shift
            shift += 7
            if c < 128:
                break
        sizes.append(v)
    out = bytearray()
    while at < len(ops):
        c = ops[at]
        at += 1
        if c > 127:
            got = [0] * 7
            for k in range(7):
                if c >> k & 1:
                    got[k] = ops[at]
                    at += 1
            start, n = int.from_bytes(bytes(got[:4]), "little"), int.from_bytes(bytes(got[4:]), "little") or 1 << 16
            if start + n > len(base):
                raise ValueError("copy beyond the base")
            out += base[start : start + n]
        elif c:
            if at + c > len(ops):
                raise ValueError("literal beyond the end")
            out += ops[at : at + c]
            at += c
        else:
            raise ValueError("reserved operation")
    if len(out) != sizes[1] or len(base) != sizes[0]:
        raise ValueError("wrong length")
    return bytes(out)


def read_pack(data: bytes, outside=lambda oid: None) -> list[tuple[str, bytes]]:
    """(kind, payload) of a pack's objects in order, deltas resolved; outside(oid) gives bases that a thin pack lacks (SRC-13, X-58)."""
    if data[:4] != b"PACK":
        raise ValueError("not a pack")
    at, by_place, by_oid, out = 12, {}, {}, []
    for _ in range(int.from_bytes(data[8:12], "big")):
        place, c = at, data[at]
        at += 1
        form, size, shift = c >> 4 & 7, c & 15, 4
        while c > 127:
            c = data[at]
            at += 1
            size |= (c & 127) << shift
            shift += 7
        base = None
        if form == 6:
            c = data[at]
            at += 1
            back = c & 127
            while c > 127:
                c = data[at]
                at += 1
                back = (back + 1 << 7) | (c & 127)
            base = by_place.get(place - back)
        elif form == 7:
            oid = data[at : at + 20].hex()
            at += 20
            base = by_oid.get(oid) or outside(oid)
        elif form not in KINDS:
            raise ValueError("unknown object type")
        z = zlib.decompressobj()
        body = z.decompress(data[at:])
        at = len(data) - len(z.unused_data)
        if len(body) != size or form > 4 and base is None:
            raise ValueError("pack object")
        got = (base[0], apply_delta(base[1], body)) if form > 4 else (KINDS[form], body)
        by_place[place] = by_oid[oid_of(*got)] = got
        out.append(got)
    return out


def _objects(files: DataFrame, read) -> DataFrame:
    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                got = read(data)
                for k in range(0, len(got), 500):
                    part = got[k : k + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([oid_of(*x) for x in part]), pa.array([x[0] for x in part]), pa.array([len(x[1]) for x in part], pa.int64()), pa.array([x[1] for x in part], pa.binary())], names=["oid", "kind", "size", "payload"])

    return files.select("content").mapInArrow(run, OBJECTS)


def objects(spark: SparkSession, git_dir: str) -> DataFrame:
    """Every object of a repository, loose or packed, once each (SRC-11, SRC-16)."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{git_dir.rstrip('/')}/objects")
    loose = _objects(every.where(F.col("path").rlike("/[0-9a-f]{2}/[0-9a-f]{38}$")), lambda d: [read_loose(d)])
    packed = _objects(every.where(F.col("path").rlike(r"\.pack$")), read_pack)
    return loose.unionByName(packed).dropDuplicates(["oid"])


def batch_stream(rows: DataFrame) -> DataFrame:
    """The objects of `cat-file --batch` output, rows(content binary) each holding whole records; a hash that differs is an error (SRC-15)."""

    def read(data: bytes):
        at, out = 0, []
        while at < len(data):
            end = data.index(b"\n", at)
            oid, kind, size = data[at:end].decode().split(" ")
            payload = data[end + 1 : end + 1 + int(size)]
            if oid_of(kind, payload) != oid:
                raise ValueError(f"hash of {oid}")
            out.append((kind, payload))
            at = end + 2 + int(size)
        return out

    return _objects(rows, read)


def refs(spark: SparkSession, git_dir: str) -> DataFrame:
    """(name, oid, target): loose refs before packed ones; HEAD may be symbolic, its target's oid resolved (SRC-14, X-54, X-55)."""
    base = git_dir.rstrip("/")
    small = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    loose = small.load(f"{base}/refs").select(F.regexp_extract("path", "/(refs/[^/].*)$", 1).alias("name"), F.trim(F.decode("content", "UTF-8")).alias("v"), F.lit(0).alias("rank"))
    top = small.load(base).where(F.col("path").rlike("/(?:HEAD|packed-refs)$")).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.decode("content", "UTF-8").alias("body"))
    head = top.where("file = 'HEAD'").select(F.lit("HEAD").alias("name"), F.regexp_replace("body", r"\s+$", "").alias("v"), F.lit(0).alias("rank"))
    line = F.explode(F.split("body", "\n"))
    packed = top.where("file = 'packed-refs'").select(line.alias("l")).where(F.col("l").rlike("^[0-9a-f]{40} ")).select(F.substring("l", 42, 1 << 20).alias("name"), F.substring("l", 1, 40).alias("v"), F.lit(1).alias("rank"))
    every = loose.withColumn("v", F.regexp_replace("v", r"\s+$", "")).unionByName(head).unionByName(packed).groupBy("name").agg(F.min_by("v", "rank").alias("v"))
    target = F.when(F.col("v").startswith("ref: "), F.substring("v", 6, 1 << 20))
    rows = every.select("name", target.alias("target"), F.when(target.isNull(), F.col("v")).alias("oid"))
    of = rows.select(F.col("name").alias("target"), F.col("oid").alias("at"))
    return rows.join(of, "target", "left").select("name", F.coalesce("oid", "at").alias("oid"), "target")


def header(payload, key: str):
    """All values of a header of a commit or tag (X-56)."""
    top = F.split(F.decode(payload, "UTF-8"), "\n\n", 2)[0]
    return F.regexp_extract_all(top, F.lit(rf"(?m)^{re.escape(key)} (.*)$"), F.lit(1))


def commits(objs: DataFrame) -> DataFrame:
    """(oid, tree, parents, author, ts, message) (F-29)."""
    x = objs.where("kind = 'commit'")
    who = T.author(F.coalesce(F.get(header(F.col("payload"), "author"), 0), F.get(header(F.col("payload"), "committer"), 0)))
    return x.select("oid", header(F.col("payload"), "tree")[0].alias("tree"), header(F.col("payload"), "parent").alias("parents"), who["who"].alias("author"), who["ts"].alias("ts"), F.coalesce(F.get(F.split(F.decode("payload", "UTF-8"), "\n\n", 2), 1), F.lit("")).alias("message"))


def tree_rows(payload: bytes) -> list[tuple[int, str, str]]:
    """(mode, name, oid) of a tree's entries (F-40)."""
    at, out = 0, []
    while at < len(payload):
        gap = payload.index(b" ", at)
        end = payload.index(b"\0", gap)
        if end + 21 > len(payload):
            raise ValueError("tree entry")
        out.append((int(payload[at:gap], 8), payload[gap + 1 : end].decode("utf-8", "replace"), payload[end + 1 : end + 21].hex()))
        at = end + 21
    return out


def tree_entries(objs: DataFrame) -> DataFrame:
    """(tree_id, name, mode, child_id) of all trees, links to other repositories left out."""

    def run(batches):
        for b in batches:
            rows = [(oid, name, mode, child) for oid, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for mode, name, child in tree_rows(p) if mode != 0o160000]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.string(), pa.int32(), pa.string()])], names=["tree_id", "name", "mode", "child_id"])

    return objs.where("kind = 'tree'").select("oid", "payload").mapInArrow(run, "tree_id string, name string, mode int, child_id string")


def tree_payload(entries) -> bytes:
    """The canonical payload of (mode, name, oid) entries: by name, directories as if they ended in a slash (X-57)."""
    order = sorted(entries, key=lambda e: e[1].encode() + (b"/" if e[0] == trees.MODE_DIR else b""))
    return b"".join(f"{mode:o} {name}".encode() + b"\0" + bytes.fromhex(oid) for mode, name, oid in order)


def links(objs: DataFrame) -> DataFrame:
    """(src, dst): commits to trees and parents, trees to entries, tags to their objects (G-06)."""
    c = commits(objs).select("oid", F.explode(F.array_append("parents", F.col("tree"))).alias("dst"))
    t = tree_entries(objs).select(F.col("tree_id").alias("oid"), F.col("child_id").alias("dst"))
    g = objs.where("kind = 'tag'").select("oid", F.explode(header(F.col("payload"), "object")).alias("dst"))
    return c.unionByName(t).unionByName(g).select(F.col("oid").alias("src"), "dst").distinct()


def missing(listed: DataFrame, store: DataFrame) -> DataFrame:
    """Ids of listed(oid) that a store(oid) lacks: what an incremental sync fetches (X-21)."""
    return listed.select("oid").distinct().join(store.select("oid"), "oid", "left_anti")


def bridged(objs: DataFrame) -> DataFrame:
    """Commits as changes with flat file listings: (change, path, mode, id) (SRC-17, J-25)."""
    roots = commits(objs).select(F.col("oid").alias("change"), F.col("tree").alias("root"))
    flat = trees.flatten(tree_entries(objs), roots.select("root").distinct())
    return roots.join(flat, "root").select("change", "path", "mode", "id")
