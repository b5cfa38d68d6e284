"""Which declaration a name means, through import aliases and re-exports (J-21).

declares(file, name): functions that a file declares. imports(file, local, source, name): a file's local name for what `source` exports as `name` (`default`, or `*` for the namespace). exports(file, name, local, source): what a file exports as
`name`; without a source it is the file's own `local`, with one it is what the source exports as `local` (`*`: the source's namespace). The row (file, *, *, source) passes on all of a source's names but `default`.

A node is an export (file, name). An explicit export stands before whatever wildcards bring; only where there is none, a node leads to the same name in each file that the wildcards name. A node means a declaration if it is the
only one that can be reached from it: two different ones make the name ambiguous, and ways that end nowhere or go in a circle bring nothing. So names are resolved by reachability on joins: wildcard nodes are made on demand,
from the names that something asks for; ways without a fork are followed by doubling pointers; only forks take rounds, in which each node keeps the least and the greatest declaration it reaches, which tells whether there is just one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import _cut, ends
from .joins import dealt_join

NODE = "struct<file:string,name:string>"


def _node(file: str, name: str):
    return F.struct(F.col(file).cast("string").alias("file"), F.col(name).cast("string").alias("name"))


def _met(rows: DataFrame, info: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """rows joined with info, which grows with the repository: by a shuffle of both, even where Spark takes info for small. It estimates tables that a few numbers in a file grow into from the file's size."""
    return rows.join(info.hint("merge"), on, how)


def targets(declares: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(node, to, found) of all explicit exports: the next export `to`, or the declaration or namespace (file, *) `found`; neither where the name is nowhere."""
    own = declares.select(F.col("file").alias("f"), F.col("name").alias("local"), F.lit(True).alias("declared")).distinct()
    taken = imports.select(F.col("file").alias("f"), "local", F.col("source").alias("from"), F.col("name").alias("of")).dropDuplicates(["f", "local"])
    x = exports.where("name <> '*'").withColumn("f", F.when(F.col("source").isNull(), F.col("file")))
    x = _met(_met(x, own, ["f", "local"], "left"), taken, ["f", "local"], "left")
    file, name = F.coalesce("source", "from"), F.when(F.col("source").isNotNull(), F.col("local")).otherwise(F.col("of"))
    there = F.struct(file.cast("string").alias("file"), name.cast("string").alias("name"))
    found = F.when(F.col("declared") & F.col("source").isNull(), _node("file", "local")).when(file.isNotNull() & (name == "*"), there)
    out = x.select(_node("file", "name").alias("node"), F.when(found.isNull() & file.isNotNull(), there).alias("to"), found.alias("found"))
    return out.groupBy("node").agg(F.min(F.struct("to", "found")).alias("x")).select("node", "x.to", "x.found")


def resolve(declares: DataFrame, imports: DataFrame, exports: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(file, name) of exports -> (file, name, status, at_file, at_name), once each: `one` with where it is declared ((file, *) is a namespace), `ambiguous` or `none`."""
    explicit = _cut(targets(declares, imports, exports))
    stars = _cut(exports.where("name = '*'").select(F.col("file").cast("string").alias("file"), F.col("source").cast("string").alias("source")).distinct())
    asked = _cut(wanted.select(_node("file", "name").alias("node")).distinct())
    steps = explicit.where("to is not null").select("node", "to")
    front = _cut(_met(asked.unionByName(steps.select(F.col("to").alias("node"))).distinct(), explicit.select("node"), "node", "left_anti"))
    seen = front
    while not front.isEmpty():  # as many rounds as wildcards stand behind one another
        named = front.where("node.name <> 'default'").select("node", F.col("node.file").alias("file"))
        new = _cut(dealt_join(named, stars.hint("merge"), ["file"]).select("node", F.struct(F.col("source").alias("file"), F.col("node.name").alias("name")).alias("to")).distinct())
        steps = steps.unionByName(new)
        front = _cut(_met(_met(new.select(F.col("to").alias("node")).distinct(), explicit.select("node"), "node", "left_anti"), seen.select("node"), "node", "left_anti"))
        seen = seen.unionByName(front)
    steps = _cut(steps)

    degree = steps.groupBy("node").agg(F.count("*").alias("n"))
    single = _met(steps, degree.where("n = 1").select("node"), "node", "left_semi").select(F.col("node").alias("id"), F.col("to").alias("up"))
    last = _cut(ends(single).select("id", "last"))  # last is null for a circle
    forks = _met(steps, degree.where("n > 1").select("node"), "node", "left_semi")
    led = _cut(_met(_met(forks, last.withColumnRenamed("id", "to"), "to", "left"), single.select(F.col("id").alias("to"), F.lit(True).alias("way")), "to", "left").select("node", F.when(F.col("way"), F.col("last")).otherwise(F.col("to")).alias("to")).where("to is not null"))
    value = explicit.where("found is not null").select("node", F.col("found").alias("low"), F.col("found").alias("high"))
    known = None
    while True:  # as many rounds as forks stand behind one another; bounds only move apart
        reached = value if known is None else value.unionByName(known)
        now = _cut(_met(led, reached.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high")))
        if known is None and now.isEmpty() or known is not None and now.exceptAll(known).isEmpty():
            break
        known = now
    reached = value if known is None else value.unionByName(known)
    at = _met(_met(asked, last.withColumnRenamed("id", "node"), "node", "left"), single.select(F.col("id").alias("node"), F.lit(True).alias("way")), "node", "left").select("node", F.when(F.col("way"), F.col("last")).otherwise(F.col("node")).alias("to"))
    got = _met(at, reached.withColumnRenamed("node", "to"), "to", "left")
    status = F.when(F.col("low").isNull(), "none").when(F.col("low") == F.col("high"), "one").otherwise("ambiguous")
    one = F.when(F.col("low") == F.col("high"), F.col("low"))
    return got.select("node.file", "node.name", status.alias("status"), one["file"].alias("at_file"), one["name"].alias("at_name"))


def callees(calls: DataFrame, declares: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """calls(file, caller, callee) -> (file, caller, callee, at_file, at_name): the declarations that callees mean. A callee is a name or a member of a namespace, `ns.name`; a file's own declaration stands before an import. Callees that mean
    nothing in the repository, or several things, are left out."""
    c = _cut(calls.select("file", "caller", "callee", F.split_part("callee", F.lit("."), F.lit(1)).alias("base"), F.when(F.col("callee").contains("."), F.expr("substring(callee, instr(callee, '.') + 1)")).alias("member")).distinct())
    own = declares.select("file", F.col("name").alias("base")).distinct()
    mine = c.where("member is null").join(own, ["file", "base"], "left_semi").select("file", "caller", "callee", F.col("file").alias("at_file"), F.col("base").alias("at_name"))
    taken = imports.select("file", F.col("local").alias("base"), F.col("source").alias("from"), F.col("name").alias("of")).dropDuplicates(["file", "base"])
    through = _cut(c.join(own, ["file", "base"], "left_anti").join(taken, ["file", "base"]))
    direct = through.where("of <> '*'")
    spaces = through.where("of = '*' and member is not null").select("file", "caller", "callee", F.col("from").alias("at"), "member")
    got = _cut(resolve(declares, imports, exports, direct.select(F.col("from").alias("file"), F.col("of").alias("name")).unionByName(spaces.select(F.col("at").alias("file"), F.col("member").alias("name")))).where("status = 'one'"))
    means = got.select(F.col("file").alias("from"), F.col("name").alias("of"), "at_file", "at_name")
    first = direct.join(means, ["from", "of"])
    out = mine.unionByName(first.where("member is null and at_name <> '*'").select("file", "caller", "callee", "at_file", "at_name"))
    out = out.unionByName(spaces.join(means.select(F.col("from").alias("at"), F.col("of").alias("member"), "at_file", "at_name"), ["at", "member"]).where("at_name <> '*'").select("file", "caller", "callee", "at_file", "at_name"))
    inner = _cut(first.where("member is not null and at_name = '*'").select("file", "caller", "callee", F.col("at_file").alias("at"), "member"))  # members of a namespace that was exported by a name
    if inner.isEmpty():
        return out
    again = resolve(declares, imports, exports, inner.select(F.col("at").alias("file"), F.col("member").alias("name"))).where("status = 'one' and at_name <> '*'")
    return out.unionByName(inner.join(again.select(F.col("file").alias("at"), F.col("name").alias("member"), "at_file", "at_name"), ["at", "member"]).select("file", "caller", "callee", "at_file", "at_name"))
