"""Review queries. reviews(id, target, reviewer, by_human, verdict, summary, labels array, findings array)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import objects

VERDICTS = ["approve", "request-changes", "reject", "comment"]


def verdict_rank(c):
    return F.array_position(F.array(*map(F.lit, VERDICTS)), c) - 1


def find(reviews: DataFrame, target: str | None = None, label: str | None = None, contains: str | None = None, verdict: str | None = None, human: bool | None = None, disputed: bool = False) -> DataFrame:
    """Reviews that meet all conditions given (FLT-01, FLT-02); disputed: only targets with two or more distinct verdicts among all reviews (J-17)."""
    out = reviews
    if disputed:
        out = out.join(reviews.groupBy("target").agg(F.count_distinct("verdict").alias("n")).where("n > 1").select("target"), "target", "left_semi")
    if target is not None:
        out = out.where(F.col("target") == target)
    if label is not None:
        out = out.where(F.array_contains("labels", label))
    if contains is not None:
        out = out.where(F.contains(F.lower("summary"), F.lit(contains.lower())))
    if verdict is not None:
        out = out.where(F.col("verdict") == verdict)
    if human is not None:
        out = out.where(F.col("by_human") == human)
    return out


def in_order(reviews: DataFrame) -> DataFrame:
    """By target, then verdict (SRT-02)."""
    return reviews.orderBy("target", verdict_rank(F.col("verdict")), "id")


def proof(changed: DataFrame) -> DataFrame:
    """changed(path, kind): every changed source with its proof: covered if a changed test has its stem, else untested; tests say so (J-16, AGG-10)."""
    rows = changed.withColumn("is_test", T.is_test_path(F.col("path")))
    stems = rows.where("is_test and kind <> 'D'").select(F.explode(T.covered_stems(F.col("path"))).alias("stem")).distinct().withColumn("covered", F.lit(True))
    out = rows.withColumn("stem", T.stem(F.col("path"))).join(stems, "stem", "left")
    return out.select("path", "kind", F.when(F.col("is_test"), "test").when(F.col("covered") & (F.col("stem") != ""), "covered").otherwise("untested").alias("proof"))


def proof_tally(proved: DataFrame) -> DataFrame:
    return proved.agg(*[F.count_if(F.col("proof") == k).alias(k) for k in ("covered", "untested", "test")])


def record(reviews: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that recording new(target, reviewer, by_human, verdict, summary, labels, findings) appends: each with its id, once each, without those of other verdicts, without a target, and those already stored (SNK-16, X-23)."""
    body = ["target", "reviewer", "by_human", "verdict", "summary", "labels", "findings"]
    named = new.where(F.col("verdict").isin(VERDICTS) & F.col("target").isNotNull()).withColumn("id", objects.object_id("review", F.to_json(F.struct(*body))))
    return objects.put(reviews, named.select("id", *body))
