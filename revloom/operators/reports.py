"""Reports over changed files: line and semantic diffs, walkthroughs. files(change, path, kind, old, new): both contents as text, null on the missing side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linediff, reviews, semdiff


def _diffs(files: DataFrame) -> DataFrame:
    """Each file's listing beside its names. Texts are read where they stand and aren't shuffled."""
    return linediff.diff(files.withColumn("key", F.lit("")), ("change", "path", "kind"))


def unified(files: DataFrame) -> DataFrame:
    """(change, path, hunk, old_start, old_len, new_start, new_len, lines) (X-28)."""
    return linediff.hunks(_diffs(files), ("change", "path")).drop("key")


def semantic_lines(files: DataFrame) -> DataFrame:
    """Added and removed lines with the definition around each, in the content of their own side: change, side, seq, file, symbol, text (X-30, F-20, F-21, WIN-08)."""
    x = linediff.changed_in(files, ("change", "path"))
    return x.select("change", "side", F.struct("path", "at").alias("seq"), F.col("path").alias("file"), "symbol", "text")


def walkthrough(files: DataFrame) -> DataFrame:
    """One row per changed file: added and deleted lines, proof (AGG-10, AGG-11, X-31)."""
    n = linediff.counts(_diffs(files), ("change", "path", "kind"))
    proof = reviews.proof(files.select("path", "kind").distinct()).select("path", "kind", "proof")
    return n.join(proof, ["path", "kind"]).select("change", "path", "kind", "added", "deleted", "proof")


def semantic(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and anomalies of each change and side (X-29, X-31, AGG-12)."""
    lines = semantic_lines(files)
    return semdiff.shape_groups(lines, ("change", "side")), semdiff.all_anomalies(lines, ("change", "side"))
