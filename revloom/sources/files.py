"""Files as tables: listings, contents, ignore rules, checkout."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import trees


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size, content) of every file below a folder, paths relative to it (SRC-01 to SRC-03, X-43, X-52). Content is read only by plans that use it."""
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "")
    prefix = F.lit(re.sub("^[a-z]+:/*(?=/)", "", base) + "/")
    return rows.select(F.substring(path, F.length(prefix) + 1, 1 << 30).alias("path"), F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def sources(listing: DataFrame) -> DataFrame:
    """The source files of a listing (SRC-22)."""
    return listing.where(T.is_source(F.col("path")) & ~T.is_ignored_path(F.col("path")))


def as_blobs(listing: DataFrame) -> DataFrame:
    """With id and whether the content is binary, i.e. has a NUL byte (D3)."""
    return listing.withColumn("id", F.sha2("content", 256)).withColumn("is_binary", F.contains("content", F.lit(b"\0").cast("binary")))


def as_text(content):
    """Bytes as text, broken sequences replaced."""
    return F.decode(content, "UTF-8")


def glob_regex(rule: str) -> str:
    """An ignore rule as a regular expression over paths relative to the rule's folder; a match ends at the path's end or before a slash."""
    anchored, rule = "/" in rule.rstrip("/"), rule.strip("/")
    out, k = "", 0
    while k < len(rule):
        c = rule[k]
        if rule.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif rule.startswith("/**", k) and k + 3 == len(rule):
            out, k = out + "/.+", k + 3
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and "]" in rule[k + 2 :]:
            end = rule.index("]", k + 2)
            inner = rule[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and k + 1 < len(rule):
            out, k = out + re.escape(rule[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    return ("" if anchored else "(?:.*/)?") + out


class Ignore:
    """Rules by folder: {folder: lines of its ignore file}. The deepest folder with an opinion wins; within one, the last rule that matches (FLT-03, X-45)."""

    ALWAYS = (".git", ".history")

    def __init__(self, rules: dict[str, list[str]]):
        self.layers = []
        for folder in sorted(rules, key=lambda f: -len([x for x in f.split("/") if x])):
            got = []
            for line in rules[folder]:
                line = line.rstrip("\n").rstrip()
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                line = line[1:] if keep or line.startswith("\\") else line
                got.append((re.compile(glob_regex(line)), line.endswith("/"), keep))
            self.layers.append((folder.strip("/"), got))

    def __call__(self, path: str, is_dir: bool = False) -> bool:
        parts = path.split("/")
        if any(p in self.ALWAYS for p in parts):
            return True
        for k in range(1, len(parts) + 1):  # a folder that is ignored takes what is below with it
            if self.one("/".join(parts[:k]), is_dir or k < len(parts)):
                return True
        return False

    def one(self, path: str, is_dir: bool) -> bool:
        for folder, rules in self.layers:
            if folder and not path.startswith(folder + "/"):
                continue
            inner = path[len(folder) + 1 :] if folder else path
            for rx, only_dir, keep in reversed(rules):
                if rx.fullmatch(inner) and (is_dir or not only_dir):
                    return not keep
        return False


def without_ignored(listing: DataFrame, rules: dict[str, list[str]], tracked: DataFrame | None = None) -> DataFrame:
    """A listing without ignored files; tracked(path) files stay (SRC-04, FLT-03). The rules go to the workers; they are a repository's ignore files, read on the driver."""
    ignore = Ignore(rules)

    @F.pandas_udf("boolean")
    def ignored(paths: pd.Series) -> pd.Series:
        return paths.map(ignore)

    kept = listing.where(~ignored("path"))
    if tracked is None:
        return kept
    held = trees.tracked(tracked)
    return kept.unionByName(listing.where(ignored("path")).join(held, "path", "left_semi"))


def checkout(files: DataFrame, target: str) -> DataFrame:
    """Writes files(path, mode, content) below a folder that all executors share: (path, status) of each (SNK-19). Names that could leave the folder, and paths through links, are refused; writing again gives the same files."""
    root = os.path.realpath(target)

    def run(batches):
        for pdf in batches:
            said = []
            for path, mode, content in zip(pdf["path"], pdf["mode"], pdf["content"], strict=True):
                parts = path.split("/")
                if len(parts) > trees.MOST_DEPTH or any(p in ("", ".", "..") or re.search(r"[\\\0]", p) for p in parts):
                    said.append("unsafe")
                    continue
                folder = os.path.join(root, *parts[:-1])
                os.makedirs(root, exist_ok=True)
                if os.path.realpath(folder) != folder:
                    said.append("through a link")
                    continue
                os.makedirs(folder, exist_ok=True)
                place = os.path.join(folder, parts[-1])
                if os.path.islink(place) or mode == trees.MODE_LINK:
                    if os.path.lexists(place):
                        os.unlink(place)
                if mode == trees.MODE_LINK:
                    os.symlink(bytes(content).decode(), place)
                else:
                    with open(place, "wb") as f:
                        f.write(bytes(content))
                    os.chmod(place, 0o755 if mode == trees.MODE_EXEC else 0o644)
                said.append("written")
            yield pd.DataFrame({"path": pdf["path"], "status": said})

    return files.select("path", F.col("mode").cast("int").alias("mode"), F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string, status string")
