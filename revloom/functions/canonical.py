"""The canonical form of free JSON (F-54, FLT-19): keys sorted at every level, no blanks.

A text becomes rows of its parts, level by level: a container is exploded into its members, each with its place, until only values are left. Then texts are folded back from the deepest level up, members in the order of their keys (in byte order)
or of their places. No function sees a whole text; a round works on one level of all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import _cut


def canonical(rows: DataFrame) -> DataFrame:
    """rows(id, json), every id once -> (id, canonical); null for a null or broken text. Of keys that an object repeats, the parser decides (it calls such a text broken)."""
    parsed = rows.select("id", F.expr("try_parse_json(json)").alias("v"))
    levels, now = [], _cut(_typed(parsed.select("id", F.lit("").alias("path"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), "v")))
    while True:
        levels.append(now)
        boxes = now.where("box is not null")
        if boxes.isEmpty():
            break
        inner = rows.sparkSession.sql("SELECT b.id, concat(b.path, '/', e.pos) AS path, b.path AS up, e.pos, e.key, e.value AS v FROM {b} b, LATERAL variant_explode(b.v) e", b=boxes)
        now = _cut(_typed(inner))
    below = None
    for level in reversed(levels):
        text = level.select("id", "path", "up", "pos", "key", "box", "text")
        if below is not None:
            text = text.join(below, ["id", "path"], "left").withColumn("text", F.coalesce("folded", "text")).drop("folded")
        said = F.when(F.col("key").isNull(), F.col("text")).otherwise(F.concat(F.expr("substring(to_json(array(key)), 2, length(to_json(array(key))) - 2)"), F.lit(":"), "text"))
        if level is levels[0]:
            return text.select("id", F.col("text").alias("canonical"))
        member = F.struct(F.coalesce("key", F.lit("")).cast("binary").alias("k"), F.col("pos").alias("p"), said.alias("t"), F.col("key").isNotNull().alias("named"))
        folded = text.groupBy("id", "up").agg(F.array_sort(F.collect_list(member)).alias("m"))
        inside = F.array_join(F.transform("m", lambda x: x["t"]), ",")
        below = folded.select("id", F.col("up").alias("path"), F.when(F.get("m", 0)["named"], F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.concat(F.lit("["), inside, F.lit("]"))).alias("folded"))


def _typed(df: DataFrame) -> DataFrame:
    """With box (object or array with members, else null) and text (of all else)."""
    kind = F.expr("schema_of_variant(v)")
    text = F.expr("to_json(v)")
    box = F.when(text.isin("{}", "[]"), None).when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
    return df.withColumn("box", box).withColumn("text", F.when(box.isNull(), text))
