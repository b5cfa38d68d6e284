"""What an object is, as one JSON text for each kind (FLT-20). Every function gives (id, kind, shown); fields without a value are null in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shown(df: DataFrame, kind: str, fields: dict[str, Column]) -> DataFrame:
    whole = F.struct(F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"), *(c.alias(name) for name, c in fields.items()))
    return df.select(F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("shown"))


def blobs(objects: DataFrame) -> DataFrame:
    """objects(id, body binary): size, and the text of those without a NUL byte; what isn't UTF-8 in it is replaced."""
    binary = F.instr(F.hex("body"), "00") > 0
    binary = binary & F.exists(F.sequence(F.lit(0), F.octet_length("body")), lambda i: F.substring("body", i + 1, F.lit(1)) == F.lit(b"\0"))  # the first test spares most bodies this one
    size = F.octet_length("body")
    plain = _shown(objects.where(~binary), "blob", {"size": size, "binary": F.lit(False), "text": F.decode("body", "UTF-8")})
    return plain.unionByName(_shown(objects.where(binary), "blob", {"size": size, "binary": F.lit(True)}))


def trees(entries: DataFrame) -> DataFrame:
    """entries(tree_id, name, mode, child_id): the entries in order of their names, modes in octal."""
    row = F.struct("name", F.lower(F.conv(F.col("mode").cast("string"), 10, 8)).alias("mode"), F.col("child_id").alias("id"))
    return _shown(entries.groupBy(F.col("tree_id").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("e")), "tree", {"entries": F.col("e")})


def changes(objects: DataFrame, verifications: DataFrame) -> DataFrame:
    """objects(id, intent, author, ts, tree, parents, session), verifications(id, verification): the verification beside a change stands before none at all."""
    x = objects.join(verifications.select("id", F.col("verification").alias("v")), "id", "left")
    fields = {"intent": F.col("intent"), "author": F.col("author").cast("string"), "timestamp": F.col("ts"), "verified": F.coalesce("v", F.lit("unverified")), "tree": F.col("tree").cast("string"), "parents": F.col("parents").cast("array<string>"), "session": F.col("session").cast("string")}
    return _shown(x, "change", fields)


def sessions(objects: DataFrame) -> DataFrame:
    """objects(id, task, model, lesson, verified, tokens_in, tokens_out, tool_calls array, tool_results array): of the calls and results, how many."""
    fields = {c: F.col(c) for c in ("task", "model", "lesson", "verified", "tokens_in", "tokens_out")}
    return _shown(objects, "session", fields | {c: F.coalesce(F.size(c), F.lit(0)) for c in ("tool_calls", "tool_results")})


def reviews(objects: DataFrame) -> DataFrame:
    """objects(id, target, reviewer, by_human, verdict, summary, labels, findings)."""
    return _shown(objects, "review", {c: F.col(c) for c in ("target", "reviewer", "by_human", "verdict", "summary", "labels", "findings")})
