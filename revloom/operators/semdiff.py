"""Semantic diff: changed lines grouped by shape, and literals or operators that deviate from a supermajority of their group.

Input everywhere: lines(seq, file, symbol, text), and any further columns named in `by` (for example a change and its side) that split the input into independent parts. seq orders the lines of a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .closure import _cut
from .joins import dealt_join

MECHANICAL, SHARE_NUM, SHARE_DEN = 3, 4, 5  # lines that make a group mechanical; the share a common value needs


def shape_groups(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per shape: by.., shape, n, kind, first_seq (AGG-01, WIN-01). Lines of blank shape are groups too."""
    shaped = lines.withColumn("shape", T.mask_shape(F.col("text")))
    return shaped.groupBy(*by, "shape").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).withColumn("kind", F.when(F.col("n") >= MECHANICAL, "mechanical").otherwise("substantive"))


def in_order(groups: DataFrame) -> DataFrame:
    """Substantive groups as first seen, then mechanical ones by size (SRT-01)."""
    return groups.orderBy(F.desc("kind"), F.when(F.col("kind") == "mechanical", -F.col("n")), "first_seq")


def _deviations(lines: DataFrame, by: tuple[str, ...], shape: Column, values: Column, say: str, least: int) -> DataFrame:
    """Lines whose value at some place differs from one that a supermajority of the group shares. Values are counted, and only groups with a rule are joined back, with all their rules at once; a group with very many lines is dealt out."""
    group = F.struct(*by, shape.alias("shape"), F.size(values).alias("width")).alias("grp")
    keyed = _cut(lines.select(*dict.fromkeys([*by, "seq", "file", "symbol", "text"]), group, values.alias("vals")).where("size(vals) > 0"))  # lines are cut into tokens once
    counts = keyed.select("grp", F.posexplode("vals").alias("at", "value")).groupBy("grp", "at", "value").agg(F.count("*").alias("c"))
    modes = counts.groupBy("grp", "at").agg(F.sum("c").alias("n"), F.max(F.struct("c", "value")).alias("top"))
    ruled = modes.where((F.col("n") >= least) & (F.col("top.c") * SHARE_DEN >= F.col("n") * SHARE_NUM) & (F.col("top.c") < F.col("n")))
    rules = ruled.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("at", F.col("top.value").alias("mode"), F.col("top.c").alias("c"), "n"))).alias("rules"))  # as many as a line has values
    met = dealt_join(keyed, rules, ["grp"]).withColumn("odd", F.filter("rules", lambda r: F.get("vals", r["at"]) != r["mode"])).where("size(odd) > 0")
    why = F.transform("odd", lambda r: F.struct(r["at"].alias("at"), F.concat(F.lit(say + " "), F.get("vals", r["at"]), F.lit(" where "), r["c"].cast("string"), F.lit("/"), r["n"].cast("string"), F.lit(" use "), r["mode"]).alias("why")))
    own = [*by, "seq", *(c for c in ("file", "symbol", "text") if c not in by)]
    found = met.select("grp", *own, why.alias("whys")).groupBy("grp", *own).agg(F.array_sort(F.flatten(F.collect_list("whys"))).alias("whys"))  # a line that stands twice under one number is one finding
    return found.select(*own, F.array_join(F.transform("whys", lambda w: w["why"]), "; ").alias("reason"))


def literal_anomalies(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Within mechanical groups: by.., seq, file, symbol, text, reason (AGG-02)."""
    return _deviations(lines, by, T.mask_shape(F.col("text")), T.literals(F.col("text")), "literal", MECHANICAL)


def operator_anomalies(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same over flip operators, grouped by operator-masked shape (AGG-03)."""
    return _deviations(lines, by, T.operator_shape(F.col("text")), T.operators(F.col("text")), "operator", MECHANICAL)


def all_anomalies(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Both, with their kind (SET-05)."""
    return literal_anomalies(lines, by).withColumn("kind", F.lit("literal")).unionByName(operator_anomalies(lines, by).withColumn("kind", F.lit("operator")))


def representatives(lines: DataFrame, anomalies: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each shape, the first line without an anomaly, else the first: by.., shape, seq, text (AGG-04)."""
    marked = lines.join(anomalies.select(*by, "seq", F.lit(1).alias("odd")).distinct(), [*by, "seq"], "left").withColumn("shape", T.mask_shape(F.col("text")))
    return marked.groupBy(*by, "shape").agg(F.min_by(F.struct("seq", "text"), F.struct(F.coalesce("odd", F.lit(0)), "seq")).alias("r")).select(*by, "shape", "r.seq", "r.text")


def audit(lines: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row: parts scanned, parts with an anomaly, anomalies (AGG-12)."""
    odd = all_anomalies(lines, by)
    a = lines.agg(F.count_distinct(F.struct(*by)).alias("scanned"))
    b = odd.agg(F.count_distinct(F.struct(*by)).alias("flagged"), F.count("*").alias("anomalies"))
    return a.join(F.broadcast(b))  # one row each


def review_rows(lines: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A review for each part with lines: labels, summary and a finding for each anomaly (X-24)."""
    odd = all_anomalies(lines, by).withColumn("finding", F.concat_ws(": ", "file", "reason"))
    found = odd.groupBy(*by).agg(F.array_sort(F.collect_list("finding")).alias("findings"))
    total = lines.groupBy(*by).agg(F.count("*").alias("lines"))
    out = total.join(found, list(by), "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<string>")))
    labels = F.when(F.size("findings") > 0, F.array(F.lit("semantic"), F.lit("anomaly"))).otherwise(F.array(F.lit("semantic")))
    return out.withColumn("labels", labels).withColumn("summary", F.concat(F.col("lines").cast("string"), F.lit(" changed lines, "), F.size("findings").cast("string"), F.lit(" anomalies")))
