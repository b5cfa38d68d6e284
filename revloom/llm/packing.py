"""Packing by optimal length buckets.

A document's length is its number of words plus one end token. The global histogram of exact lengths goes to the driver: one row for each length that occurs, which the longest
text bounds (d different lengths take at least d (d + 1) / 2 tokens), not the number of documents. Dynamic programming over it picks the `buckets` upper edges with the least padding; an edge is the length of its bucket's
longest document. The padding of a bucket is a Monge function of its ends, so that each row of the program is solved by divide and conquer: O(buckets x d log d). Inside a bucket, documents
form batches whose padded size (documents x the bucket's edge) stays within `budget` tokens; a longer document is a batch of its own.

No window ever holds a whole bucket's documents: a bucket is cut into shards of about rows_per_shard by a hash of the document, each shard is numbered on its own, and the
shards' starting numbers are running sums of the (bucket, shard) counts. Batches therefore run on across shards and only the last of a bucket is partial.

Defined results: a null or empty text has length 1 (the end token). A null doc_id sorts first. Repeated rows are packed as often as they
occur. An empty table gives no rows. Texts of any length are counted whole. Only doc_id and text are read, so that other columns may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written



def n_words(text):
    """Words between runs of ASCII white space, 0 for null or empty."""
    t = F.coalesce(text, F.lit(""))
    runs = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    return runs.cast("long")


def best_edges(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper edges of at most `buckets` groups of neighbouring lengths (ascending, with their counts) for which the padding is least."""
    n = len(lengths)
    if n == 0:
        return []
    c = np.concatenate([[0], np.cumsum(counts)])
    edge = np.concatenate([[0], lengths])

    # padding of all documents of lengths i..j-1 in one bucket: edge[j] * (c[j] - c[i]) less their tokens, which are the same for any cuts
    best, cuts = np.where(np.arange(n + 1) > 0, np.inf, 0.0), []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:  # the best last cut of j lies between those of its neighbours
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            costs = best[i] + edge[j] * (c[j] - c[i]).astype(np.float64)
            k = int(np.argmin(costs))
            new[j], cut[j] = costs[k], i[k]
            todo += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        new[0] = 0  # fewer buckets will do
        best = new
        cuts.append(cut)
    j, out = n, []
    for cut in reversed(cuts):
        if not j:
            break
        out.append(int(edge[j]))
        j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 8, budget: int = 65536, rows_per_shard: int = 100_000) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket (from 0), bucket_edge, batch_id (from 0 within its bucket), padding."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", (n_words(F.col("text")) + 1).alias("n_tokens"))
    rows = written(rows, "lengths")
    grid = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    if not grid:
        return spark.createDataFrame([], "doc_id long, n_tokens long, bucket int, bucket_edge long, batch_id long, padding long")
    edges = best_edges(*(np.array([r[k] for r in grid], dtype=np.int64) for k in ("n_tokens", "n")), buckets)
    bucket, edge = F.lit(0), F.lit(edges[0])
    for k in range(1, len(edges)):
        beyond = F.col("n_tokens") > edges[k - 1]
        bucket, edge = F.when(beyond, F.lit(k)).otherwise(bucket), F.when(beyond, F.lit(edges[k])).otherwise(edge)
    shards = max(1, -(-int(sum(r["n"] for r in grid)) // rows_per_shard))
    rows = rows.select("doc_id", "n_tokens", bucket.cast("int").alias("bucket"), edge.cast("long").alias("bucket_edge"), F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int").alias("shard"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over counts of shards, not documents
    offsets = rows.groupBy("bucket", "shard").count().select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    w = Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_edge"))).cast("long")
    numbered = rows.join(offsets, ["bucket", "shard"]).withColumn("at", F.col("start") + F.row_number().over(w) - 1)
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "bucket_edge", F.floor(F.col("at") / room).cast("long").alias("batch_id"), (F.col("bucket_edge") - F.col("n_tokens")).alias("padding")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
