"""Benchmark decontamination: size-partitioned MinHash containment search, native expressions only.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; a text's set is its distinct five-word shingles, or its whole sequence of words if it
has fewer. A document is contaminated by an item if it contains at least `threshold` of the item's shingles.

Items are partitioned by the size of their sets (powers of two). A partition's items are signed with their k smallest MinHash values, where k is
one more than the shingles that may be missing at the partition's upper size: of these, a contaminated document must hold at least one,
whatever its own length, so the search has no false negatives even where an item is a thousandth of a document. Documents look their shingles
up in the signatures; the candidate pairs are then verified by comparing the shingles themselves, as texts.

The signature table is broadcast only if it has at most BROADCAST_ROWS rows (12 bytes each); a larger one is joined by shuffle, where hot shingles
are Spark's to split.

Defined results: a null or empty document or item has no shingles and no match. A null doc_id or item_id takes no part. Repeated rows of documents with one
doc_id are united; an item_id with several texts is matched by each. Only doc_id, text and item_id are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

K = 5
BROADCAST_ROWS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    """The words of a lower-cased text; none for null or empty."""
    t = F.translate(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def shingle_texts(w: str):
    """An array of the five-word shingles of the array column w, with repeats."""
    return F.expr(f"CASE WHEN size({w}) = 0 THEN CAST(array() AS array<string>) WHEN size({w}) < {K} THEN array(array_join({w}, ' ')) ELSE transform(sequence(1, size({w}) - {K - 1}), i -> array_join(slice({w}, i, {K}), ' ')) END")


def exploded_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, h) for each place of a shingle; h depends on the shingle's words only."""
    hashed = docs.select("doc_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    each = ", ".join(f"w[i + {k}]" for k in range(K))
    h = F.expr(f"CASE WHEN size(w) = 0 THEN CAST(array() AS array<bigint>) WHEN size(w) < {K} THEN array(xxhash64(w)) ELSE transform(sequence(0, size(w) - {K}), i -> xxhash64({each})) END")
    return hashed.select("doc_id", F.explode(h).alias("h"))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_key, item_id, size, shingle, h): the distinct shingles of each item text."""
    rows = items.where("item_id is not null").select("item_id", F.xxhash64("item_id", "text").alias("item_key"), words(F.col("text")).alias("w")).dropDuplicates(["item_key"])
    rows = rows.select("item_id", "item_key", F.array_distinct(shingle_texts("w")).alias("s")).where("size(s) > 0")
    rows = rows.select("item_id", "item_key", F.size("s").alias("size"), F.explode("s").alias("shingle"))
    parts = F.split("shingle", " ")
    same = F.transform(parts, lambda x: F.xxhash64(x))
    rows = rows.withColumn("w", same)
    each = ", ".join(f"w[{k}]" for k in range(K))
    return rows.withColumn("h", F.expr(f"CASE WHEN size(w) < {K} THEN xxhash64(w) ELSE xxhash64({each}) END")).drop("w")


def signatures(shingles: DataFrame, threshold: float) -> DataFrame:
    """(h, item_key): the k smallest hashes of each item, k by the item's size partition."""
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("size").cast("double"))))
    k = (F.floor((1 - threshold) * upper + 1e-9) + 1).cast("int")
    sets = shingles.groupBy("item_key", "size").agg(F.array_sort(F.collect_set("h")).alias("hs")).withColumn("k", k)
    return sets.select("item_key", F.explode(F.expr("slice(hs, 1, k)")).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_shared, n_item, containment."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    shingles = written(item_shingles(items), "items")
    signed = signatures(shingles, threshold)
    fits = shingles.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    near = (lambda df: F.broadcast(df)) if fits else (lambda df: df)
    candidates = written(exploded_hashes(docs).join(near(signed), "h").select("doc_id", "item_key").distinct(), "candidates")
    texts = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    held = texts.select("doc_id", F.explode(F.array_distinct(shingle_texts("w"))).alias("shingle"))
    shared = held.join(near(shingles), "shingle").select("doc_id", "item_key", "item_id", "size", "shingle")
    shared = shared.join(candidates, ["doc_id", "item_key"], "left_semi")
    counted = shared.groupBy("doc_id", "item_key", "item_id", "size").agg(F.count_distinct("shingle").alias("n_shared"))
    found = counted.where(F.col("n_shared") >= F.col("size") * F.lit(threshold))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("size"), "n_shared", "size")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_shared").cast("long").alias("n_shared"), F.col("m.size").cast("long").alias("n_item"), (F.col("m.n_shared") / F.col("m.size")).alias("containment"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 'b' GROUP BY id),
p AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM s d JOIN s b ON d.s = b.s AND d.kind = 'd' AND b.kind = 'b' GROUP BY 1, 2)
SELECT doc_id, p.item_id, n_shared::BIGINT AS n_shared, n_item::BIGINT AS n_item, n_shared / n_item AS containment FROM p JOIN n ON p.item_id = n.item_id WHERE 100 * n_shared >= 75 * n_item
"""
