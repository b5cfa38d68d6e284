"""Seeded cases to measure detection with (X-77): every draw is a hash of seed, class, number and its own name, so that rows don't depend on partitions, order or how many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operators and numbers that cases are made of, and which classes hold a bug.
COMPARE, LOGICAL = ["<", "<=", ">", ">=", "==", "!="], ["&&", "||"]
NUMBERS = [2, 3, 4, 5, 8, 16]
NAMES = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
CLASSES = {"op-flip-added": "added", "literal-smuggle": "added", "op-flip-removed": "removed", "clean-uniform": "clean", "clean-varied-op": "clean", "clean-varied-lit": "clean"}


def draw(seed: int, name: str, below) -> Column:
    """A number from 0 to below - 1 for each row's class and number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "class", F.col("number").cast("string"), F.lit(name)).cast("binary")), 1, 8), 16, 10).cast("long") % below


def cases(numbers: DataFrame, seed: int = 1094) -> DataFrame:
    """numbers(number) -> (class, number, side, is_bug, line, odd, text): the lines of a case of each class for each number. odd: whether the line is the one that deviates."""
    kinds = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(s).alias("side")) for c, s in CLASSES.items()])
    x = numbers.select("number", F.explode(kinds).alias("k")).select("number", "k.class", "k.side")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    every = COMPARE + LOGICAL
    removed, varied = F.col("class") == "op-flip-removed", F.col("class") == "clean-varied-op"
    n = F.when(varied, len(COMPARE)).otherwise(6 + draw(seed, "lines", 4)).cast("int")
    kinds_of = F.when(removed, len(COMPARE)).otherwise(len(every))
    major = draw(seed, "major", kinds_of)
    minor = (major + 1 + draw(seed, "minor", kinds_of - 1)) % kinds_of
    number = draw(seed, "number", len(NUMBERS))
    other = (number + 1 + draw(seed, "other", len(NUMBERS) - 1)) % len(NUMBERS)
    first = draw(seed, "first", len(NAMES))
    second = (first + 1 + draw(seed, "second", len(NAMES) - 1)) % len(NAMES)
    x = x.withColumns({"n": n, "at": draw(seed, "odd", n).cast("int"), "major": pick(every, major), "minor": pick(every, minor), "number_1": pick(NUMBERS, number), "number_2": pick(NUMBERS, other), "name_1": pick(NAMES, first), "name_2": pick(NAMES, second)})
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("line"))
    is_bug = F.col("side") != "clean"
    odd = is_bug & (F.col("line") == F.col("at"))
    flips = F.col("class").isin("op-flip-added", "op-flip-removed")
    op = F.when(flips & odd, F.col("minor")).when(flips | (F.col("class") == "clean-uniform"), F.col("major")).when(varied, pick(COMPARE, F.col("line"))).otherwise("<=")
    literal = F.when(F.col("class") == "literal-smuggle", F.when(odd, F.col("number_2")).otherwise(F.col("number_1"))).when(F.col("class") == "clean-uniform", 7).when(F.col("class") == "clean-varied-lit", F.col("line")).otherwise(1)
    k = F.col("line").cast("string")
    guard = F.concat(F.lit("if ("), "name_1", k, F.lit(" "), op, F.lit(" max) throw Error();"))
    plain = F.concat(F.lit("const r"), k, F.lit(" = "), "name_1", k, F.lit(" "), op, F.lit(" lim && ok("), "name_2", k, F.lit(", "), literal.cast("string"), F.lit(");"))
    return x.select("class", "number", "side", is_bug.alias("is_bug"), "line", odd.alias("odd"), F.when(removed, guard).otherwise(plain).alias("text"))


def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows of cases, found(class, number, line) of anomalies -> (class, number, is_bug, flagged): a bug is flagged if its odd line is among what was found, a clean case if anything was."""
    hits = rows.join(found.select("class", "number", "line", F.lit(True).alias("hit")).distinct(), ["class", "number", "line"], "left")
    return hits.groupBy("class", "number", "is_bug").agg(F.max(F.coalesce("hit", F.lit(False)) & (F.col("odd") | ~F.col("is_bug"))).alias("flagged"))
