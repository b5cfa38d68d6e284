"""Statistics of trials, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The deviation of 95 % intervals, the margin of equivalence.
Z, MARGIN = 1.96, 0.2


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The interval of a share; (0, 0) without trials (F-50)."""
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))
    end = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / (1 + z2 / n)))).otherwise(0.0)
    return end(mid - half), end(mid + half)


def erf(x: Column, terms: int = 60) -> Column:
    """The error function to about 1e-12: its series where |x| < 3, a continued fraction beyond (Spark has none). F-52"""
    a = F.abs(x)
    near = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(a.alias("term"), a.alias("sum")),
        lambda acc, k: F.struct((acc["term"] * 2 * a * a / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"] * 2 * a * a / (2 * k + 1)).alias("sum")),
        lambda acc: acc["sum"] * (2 / math.sqrt(math.pi)) * F.exp(-a * a),
    )
    tail = F.lit(0.0)
    for k in range(40, 0, -1):
        tail = (k / 2) / (a + tail)
    far = 1 - F.exp(-a * a) / (math.sqrt(math.pi) * (a + tail))
    return F.signum(x) * F.when(a < 3, near).otherwise(far)


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def compared(k1: Column, n1: Column, k2: Column, n2: Column, margin: float = MARGIN, z: float = Z) -> Column:
    """struct(diff, p, low, high, within): the first share less the second, pooled two-sided test, unpooled interval, and whether the interval lies inside the margin, its ends included (F-51)."""
    p1, p2 = k1 / n1, k2 / n2
    pool = (k1 + k2) / (n1 + n2)
    se0, se = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2)), F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    diff = p1 - p2
    p = F.when(se0 > 0, 2 * (1 - normal_cdf(F.abs(diff) / se0))).otherwise(1.0)
    return F.struct(diff.alias("diff"), p.alias("p"), (diff - z * se).alias("low"), (diff + z * se).alias("high"), (F.abs(diff) + z * se <= margin).alias("within"))


def holm(pvals: DataFrame, keys: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Step-down rejections in each part: keys.. name the part; adds rank and rejected (WIN-11)."""
    w = Window.partitionBy(*keys).orderBy(p, *[c for c in pvals.columns if c not in keys and c != p])
    whole = Window.partitionBy(*keys)
    ranked = pvals.withColumn("rank", F.row_number().over(w)).withColumn("m", F.count("*").over(whole))
    ok = F.col(p) <= alpha / (F.col("m") - F.col("rank") + 1)
    return ranked.withColumn("rejected", F.min(ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1).drop("m")


def summarise(trials: DataFrame, *keys: str) -> DataFrame:
    """trials(keys.., ok): keys.., correct, total, pct, low, high (AGG-15)."""
    n = trials.groupBy(*keys).agg(F.count_if("ok").alias("correct"), F.count("*").alias("total"))
    low, high = wilson(F.col("correct"), F.col("total"))
    return n.select(*keys, "correct", "total", (F.col("correct") / F.col("total")).alias("pct"), low.alias("low"), high.alias("high"))


def compare_runs(a: DataFrame, b: DataFrame, margin: float = MARGIN, z: float = Z) -> DataFrame:
    """Two reports(bench, condition, correct, total): shared rows compared, the rest marked only_a or only_b (J-29, SET-08). Rows whose counts make no share (null, negative, none in all, more right than in all) are "invalid"."""
    x = a.select("bench", "condition", F.col("correct").alias("k1"), F.col("total").alias("n1"))
    y = b.select("bench", "condition", F.col("correct").alias("k2"), F.col("total").alias("n2"))
    share = lambda k, n: F.coalesce((F.col(n) > 0) & F.col(k).between(0, F.col(n)), F.lit(False))
    found = lambda c, k, n: c.select("*", share(k, n).alias(f"ok_{k}"), F.lit(True).alias(f"in_{k}"))
    side = F.when(F.col("in_k2").isNull(), "only_a").when(F.col("in_k1").isNull(), "only_b").when(F.col("ok_k1") & F.col("ok_k2"), "both").otherwise("invalid")
    out = found(x, "k1", "n1").join(found(y, "k2", "n2"), ["bench", "condition"], "full_outer").withColumn("side", side)
    return out.withColumn("r", F.when(F.col("side") == "both", compared(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"), margin, z))).select("bench", "condition", "k1", "n1", "k2", "n2", "side", "r.*")


def verdict(compared_rows: DataFrame, manifests: tuple[str | None, str | None], z: float = Z) -> DataFrame:
    """One row (X-76): manifest_mismatch unless both runs name the same manifest; no_data if nothing is shared; regression if a shared row differs by Holm's step-down over p-values of four places, at the level that z
    stands for; equivalent if every row's interval lies inside the margin; else inconclusive. With its exit code: 0 for equivalent, 1 for regression, 2 for all else."""
    alpha = 2 * (1 - 0.5 * (1 + math.erf(z / math.sqrt(2))))
    shared = compared_rows.where("side = 'both'").select("bench", "condition", F.round("p", 4).alias("p"), "within", F.lit(0).alias("part"))
    x = holm(shared, ["part"], alpha=alpha).agg(F.count("*").alias("n"), F.max("rejected").alias("differs"), F.min("within").alias("all_within"))
    name = F.lit("manifest_mismatch") if manifests[0] is None or manifests[0] != manifests[1] else F.when(F.col("n") == 0, "no_data").when(F.col("differs"), "regression").when(F.col("all_within"), "equivalent").otherwise("inconclusive")
    out = x.select(name.alias("verdict"))
    return out.withColumn("exit_code", F.when(F.col("verdict") == "equivalent", 0).when(F.col("verdict") == "regression", 1).otherwise(2))


def detection(results: DataFrame) -> DataFrame:
    """results(class, is_bug, flagged): by class recall or false-positive rate (AGG-17)."""
    return results.groupBy("class", "is_bug").agg(F.avg(F.col("flagged").cast("double")).alias("rate"), F.count("*").alias("n"))


def manifest_digest(parts: DataFrame, *keys: str) -> DataFrame:
    """parts(keys.., name, value) -> sha256 of their canonical JSON, names in order (AGG-23, F-53, X-73, X-74)."""
    obj = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))))
    return parts.groupBy(*keys).agg(F.sha2(obj, 256).alias("digest"), F.count("*").alias("parts"))


def usage(events: DataFrame) -> DataFrame:
    """events(verb, tokens_out, displaced) by verb and in total (AGG-13); the total's verb is null."""
    return events.rollup("verb").agg(F.count("*").alias("calls"), F.sum("tokens_out").alias("tokens_out"), F.sum("displaced").alias("displaced"))


def scenario_problems(scenarios: DataFrame, expected: int) -> DataFrame:
    """scenarios of string columns: one row of whether the count is right and whether any field is blank (X-75)."""
    blank = F.lit(False)
    for c in scenarios.columns:
        blank = blank | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    return scenarios.agg((F.count("*") == expected).alias("count_ok"), F.coalesce(~F.bool_or(blank), F.lit(True)).alias("fields_ok"))


def fan_out(scenarios: DataFrame, conditions: list[str], trials: int) -> DataFrame:
    """Each scenario for each condition and trial (X-72)."""
    return scenarios.withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
