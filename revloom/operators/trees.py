"""Trees of entries, flat listings, and differences between them.

tree_entries(tree_id, name, mode, child_id); a mode of MODE_DIR (octal 040000) is a subtree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .closure import _cut
from .joins import dealt_join

MODE_FILE, MODE_EXEC, MODE_DIR, MODE_LINK, MOST_DEPTH = 0o100644, 0o100755, 0o040000, 0o120000, 256


def flatten(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The files below roots(root): (root, path, mode, id), level by level (J-18, X-42)."""
    level = _cut(roots.select("root", F.lit("").alias("prefix"), F.col("root").alias("tree_id")))
    out = None
    for _ in range(MOST_DEPTH):
        met = _cut(level.join(entries, "tree_id").select("root", F.concat("prefix", "name").alias("path"), "mode", F.col("child_id").alias("id")))
        files = met.where(F.col("mode") != MODE_DIR)
        out = files if out is None else out.unionByName(files)
        level = met.where(F.col("mode") == MODE_DIR).select("root", F.concat("path", F.lit("/")).alias("prefix"), F.col("id").alias("tree_id"))
        if level.isEmpty():
            break
    return out


def diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = (), with_mode: bool = True) -> DataFrame:
    """Two listings (keys.., path, id, mode): keys.., path, kind A, M or D (J-01 to J-04). with_mode=False compares ids alone. A file that becomes a directory shows as D of it and A of what is in it."""
    on = [*keys, "path"]
    a, b = old.select(*on, F.col("id").alias("old_id"), F.col("mode").alias("old_mode")), new.select(*on, F.col("id").alias("new_id"), F.col("mode").alias("new_mode"))
    same = F.col("old_id").eqNullSafe(F.col("new_id")) & (F.col("old_mode").eqNullSafe(F.col("new_mode")) if with_mode else F.lit(True))
    kind = F.when(F.col("old_id").isNull(), "A").when(F.col("new_id").isNull(), "D").when(~same, "M")
    return a.join(b, on, "full_outer").withColumn("kind", kind).where("kind is not null")


def tally(changes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many of each kind (X-20)."""
    return changes.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in "AMD"])


def at_path(listing: DataFrame, path: str) -> DataFrame:
    """FLT-13: a filter on the flat path, which reaches the scan."""
    return listing.where(F.col("path") == path)


def tracked(listing: DataFrame) -> DataFrame:
    """Every file and every directory above one (X-36)."""
    return listing.select(F.explode(F.array_append(T.ancestors_of(F.col("path")), F.col("path"))).alias("path")).distinct()


def emit_side(entries: DataFrame, sides: DataFrame) -> DataFrame:
    """sides(path, id, kind): folders that only one side of a comparison has -> (path, kind, mode, id) of every file below them (X-37). A tree that stands at several places is flattened once."""
    files = flatten(entries, sides.select(F.col("id").alias("root")).distinct()).withColumnRenamed("path", "inner")
    at = _cut(sides.select("path", "kind", F.col("id").alias("root")))
    return dealt_join(at, files, ["root"]).select(F.when(F.col("path") == "", F.col("inner")).otherwise(F.concat_ws("/", "path", "inner")).alias("path"), "kind", "mode", "id")


def tree_ids(files: DataFrame) -> DataFrame:
    """files(path, mode, id) -> (dir, tree_id, entries): ids of all directories from the deepest up; a directory's id is the hash of its entries in order of their names (G-09, SRC-01)."""
    now = files.select(T.directory(F.col("path")).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"), "mode", "id")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    most = now.agg(F.max(depth)).collect()[0][0]
    out = None
    pending = _cut(now)
    for d in range(most or 0, -1, -1):
        level = pending.where(depth == d).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("name", "mode", "id"))).alias("entries"))
        body = F.array_join(F.transform("entries", lambda e: F.concat(e["mode"].cast("string"), F.lit(" "), e["name"], F.lit("\u0000"), e["id"])), "")
        level = _cut(level.withColumn("tree_id", F.sha2(F.concat(F.lit("tree\u0000"), body), 256)))
        out = level if out is None else out.unionByName(level)
        if d:
            up = level.select(T.directory(F.col("dir")).alias("dir"), F.element_at(F.split("dir", "/"), -1).alias("name"), F.lit(MODE_DIR).alias("mode"), F.col("tree_id").alias("id"))
            pending = _cut(pending.where(depth < d).unionByName(up))
    return out


def cached_ids(walk: DataFrame, cache: DataFrame, epoch: int) -> DataFrame:
    """walk(path, mtime, size, content) with ids: a cached id counts if time and size are equal and the time lies before the epoch at which the cache was written, else content is hashed (J-05, STR-11, SRC-10)."""
    c = cache.select("path", F.col("mtime").alias("c_mtime"), F.col("size").alias("c_size"), F.col("id").alias("c_id"))
    hit = (F.col("mtime") == F.col("c_mtime")) & (F.col("size") == F.col("c_size")) & (F.col("mtime") < epoch)
    return walk.join(c, "path", "left").select("path", "mtime", "size", F.when(hit, F.col("c_id")).otherwise(F.sha2("content", 256)).alias("id"), F.coalesce(hit, F.lit(False)).alias("hit"))


def read_at(content, offset: int, length: int):
    """A byte range of a binary column, clamped to its end (SRC-30, SRC-31)."""
    return F.substring(content, offset + 1, length)
