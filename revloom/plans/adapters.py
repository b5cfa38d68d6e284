"""The supplied tables seen as the engine's relations, as projections that SQL can repeat; SQL holds the same as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


class Tables:
    """The tables of a folder, read when used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Few short rows that grow into many or long ones, dealt over as many tasks as a shuffle has; a small file would else be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lines(t: Tables) -> DataFrame:
    """Every line of the documents: seq, file, symbol, text."""
    each = t.documents.select("doc_id", "source", F.posexplode(T.lines(F.col("text"))).alias("pos", "text"))
    return each.select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("seq"), F.col("source").alias("file"), F.lit(None).cast("string").alias("symbol"), "text")


LINES = r"""
  doc_lines AS (SELECT doc_id, source, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) END AS ls FROM documents),
  lines AS (SELECT doc_id * 1000000 + pos - 1 AS seq, source AS file, CASE WHEN ends_with(l, chr(13)) THEN l[:-2] ELSE l END AS text FROM (SELECT doc_id, source, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM doc_lines))
"""


def code(t: Tables) -> DataFrame:
    """Two lines of code for each line item, in which a few carry another number or operator: seq, file, symbol, text."""
    at = F.col("l_orderkey") * 16 + F.col("l_linenumber") * 2
    number = F.concat(F.lit("set("), F.when(F.col("l_orderkey") % 17 == 0, "3").otherwise("2"), F.lit(")"))
    compare = F.concat(F.lit("if (i"), F.when(F.col("l_partkey") % 23 == 0, " < ").otherwise(" <= "), F.lit("n)"))
    both = F.array(F.struct(at.alias("seq"), number.alias("text")), F.struct((at + 1).alias("seq"), compare.alias("text")))
    return t.lineitem.select(F.col("l_suppkey").cast("string").alias("file"), F.explode(both).alias("x")).select("x.seq", "file", F.lit(None).cast("string").alias("symbol"), "x.text")


CODE = """
  code AS (SELECT l_orderkey * 16 + l_linenumber * 2 AS seq, l_suppkey::VARCHAR AS file, 'set(' || CASE WHEN l_orderkey % 17 = 0 THEN '3' ELSE '2' END || ')' AS text FROM lineitem
    UNION ALL SELECT l_orderkey * 16 + l_linenumber * 2 + 1, l_suppkey::VARCHAR, 'if (i' || CASE WHEN l_partkey % 23 = 0 THEN ' < ' ELSE ' <= ' END || 'n)' FROM lineitem)
"""

#: Tokens of a line and their masks, for expressions without look-ahead.
TOKEN_SQL = r"""(?s)\s+|[_\p{L}][_\p{L}\p{N}]*|(?:[0-9]|\.[0-9])[\p{L}\p{N}._]*|"(?:\\.|[^"\\])*"|"[^"]*\\"(?:\\.|[^"\\])*$|[<>=!&|^~+*/%-]+|."""
MASK_SQL = r"""CASE WHEN regexp_matches(t, '^\s') THEN ' ' WHEN regexp_matches(t, '^[_\p{L}]') THEN '_' WHEN regexp_matches(t, '^(?:[0-9]|\.[0-9])') THEN '#' WHEN length(t) > 1 AND t[1] = '"' THEN '""' ELSE t END"""


def tokens_sql(text: str = "text") -> str:
    return f"regexp_extract_all({text}, '{TOKEN_SQL}')"


def shape_sql(text: str = "text") -> str:
    return f"trim(array_to_string(list_transform({tokens_sql(text)}, lambda t: {MASK_SQL}), ''))"


def changes(t: Tables) -> DataFrame:
    """Orders as changes: the mainline parent is the customer's order before, a tenth also have the one before that as second parent."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = t.orders.select("*", F.lag("o_orderkey").over(w).alias("p1"), F.when(F.col("o_orderkey") % 10 == 0, F.lag("o_orderkey", 2).over(w)).alias("p2"), F.row_number().over(w).alias("at"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))
    said = F.when(F.col("o_orderstatus") == "F", "green").when(F.col("o_orderstatus") == "P", "red").otherwise("unverified")
    return x.select(
        F.col("o_orderkey").alias("id"), F.array_compact(F.array("p1", "p2")).alias("parents"), F.col("o_custkey").alias("author"), T.epoch_seconds("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("intent"),
        said.alias("verification"), (F.col("at") == F.col("n")).alias("is_head"),
    )


CHANGES = """
  changes AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS p1, CASE WHEN o_orderkey % 10 = 0 THEN lag(o_orderkey, 2) OVER w END AS p2, o_custkey AS author, epoch(o_orderdate)::BIGINT AS ts, o_orderpriority AS intent,
    CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'P' THEN 'red' ELSE 'unverified' END AS verification, lead(o_orderkey) OVER w IS NULL AS is_head FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
"""


def change_files(t: Tables) -> DataFrame:
    """change, path, blob, mode: the last line of each part in an order."""
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("part")).agg(F.max_by(F.struct("l_suppkey", "l_quantity"), F.struct("l_linenumber", "l_suppkey", "l_quantity")).alias("r"))
    return x.select("change", F.concat(F.lit("d"), (F.col("part") % 50).cast("string"), F.lit("/p"), F.col("part").cast("string")).alias("path"), F.col("r.l_suppkey").cast("string").alias("id"), (F.col("r.l_quantity").cast("int") % 2).alias("mode"))


CHANGE_FILES = """
  change_files AS (SELECT l_orderkey AS change, 'd' || (l_partkey % 50)::VARCHAR || '/p' || l_partkey::VARCHAR AS path, arg_max(l_suppkey, (l_linenumber, l_suppkey, l_quantity))::VARCHAR AS id, arg_max(l_quantity, (l_linenumber, l_suppkey, l_quantity))::INT % 2 AS mode FROM lineitem GROUP BY l_orderkey, l_partkey)
"""


def edges(t: Tables) -> DataFrame:
    """A dependency graph over parts, with cycles."""
    n = t.part.agg(F.count("*").alias("n"))
    x = t.part.select("p_partkey").join(F.broadcast(n))
    two = F.array(F.floor(F.col("p_partkey") / 2).cast("long"), F.when(F.col("p_partkey") % 5 == 0, (F.col("p_partkey") * 7 + 1) % F.col("n")))
    return x.select(F.col("p_partkey").alias("src"), F.explode(F.array_compact(two)).alias("dst")).where("src <> dst").distinct()


EDGES = """
  edges AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey <> p_partkey // 2
    UNION SELECT p_partkey, (p_partkey * 7 + 1) % (SELECT count(*) FROM part) FROM part WHERE p_partkey % 5 = 0 AND p_partkey <> (p_partkey * 7 + 1) % (SELECT count(*) FROM part))
"""


def holds(t: Tables) -> DataFrame:
    """file, agent, task, taken: the last event of each file."""
    x = t.events.select(F.get_json_object("props", "$.k").alias("file"), F.col("user_id").cast("string").alias("agent"), F.col("event_type").alias("task"), T.epoch_seconds("ts").alias("taken"), "event_id").where("file is not null")
    return x.groupBy("file").agg(F.max_by(F.struct("agent", "task", "taken"), F.struct("taken", "event_id")).alias("r")).select(F.concat(F.lit("d"), F.col("file").cast("int") % 7, F.lit("/"), "file").alias("file"), "r.*")


HOLDS = """
  held AS (SELECT json_extract_string(props, '$.k') AS file, user_id::VARCHAR AS agent, event_type AS task, floor(epoch(ts))::BIGINT AS taken, event_id FROM events),
  holds AS (SELECT 'd' || (file::INT % 7)::VARCHAR || '/' || file AS file, agent, task, taken FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY taken DESC, event_id DESC) AS rn FROM held WHERE file IS NOT NULL) WHERE rn = 1)
"""


def reviews(t: Tables) -> DataFrame:
    """Two reviews for each label: of quality by a person, of tone by a program."""
    row = lambda who, human, good: F.struct(
        F.concat(F.col("doc_id").cast("string"), F.lit("-" + who)).alias("id"), F.lit(who).alias("reviewer"), F.lit(human).alias("by_human"), F.when(good, "approve").otherwise("reject").alias("verdict"),
        F.concat(F.lit(who.capitalize() + " of "), "lang").alias("summary"), F.array(F.lit(who), "lang").alias("labels"), F.array().cast("array<string>").alias("findings"),
    )
    both = F.array(row("quality", True, F.col("quality") == 1), row("tone", False, F.col("toxic") == 0))
    return t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("target"), F.explode(both).alias("r")).select("target", "r.*")


REVIEWS = """
  reviews AS (SELECT doc_id AS target, doc_id::VARCHAR || '-quality' AS id, 'quality' AS reviewer, true AS by_human, CASE WHEN quality = 1 THEN 'approve' ELSE 'reject' END AS verdict, 'Quality of ' || lang AS summary, ['quality', lang] AS labels FROM labels JOIN documents USING (doc_id)
    UNION ALL SELECT doc_id, doc_id::VARCHAR || '-tone', 'tone', false, CASE WHEN toxic = 0 THEN 'approve' ELSE 'reject' END, 'Tone of ' || lang, ['tone', lang] FROM labels JOIN documents USING (doc_id))
"""


def modules(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as modules: declares, imports, exports. Each declares one function and exports it by another name; thirds pass on names of other parts by alias, quarters all names of one or two others."""
    k = F.col("p_partkey")
    n = F.broadcast(t.part.agg(F.count("*").alias("n")))
    name = lambda prefix, x: F.concat(F.lit(prefix), (x % 40).cast("string"))
    file = lambda x: F.concat(F.lit("m"), x.cast("long").cast("string"))
    none = F.lit(None).cast("string")
    row = lambda a, b, c: F.struct(a.alias("name"), b.alias("local"), c.alias("source"))
    parts = t.part.select("p_partkey").join(n)
    declares = parts.select(file(k).alias("file"), name("f", k).alias("name"))
    imports = parts.where(k % 3 == 1).select(file(k).alias("file"), F.lit("h").alias("local"), file(F.floor(k / 2)).alias("source"), name("g", F.floor(k / 2)).alias("name"))
    rows = F.array_compact(F.array(
        row(name("g", k), name("f", k), none), F.when(k % 3 == 0, row(name("a", k), name("g", F.floor(k / 3)), file(F.floor(k / 3)))), F.when(k % 3 == 1, row(name("h", k), F.lit("h"), none)),
        F.when(k % 4 == 0, row(F.lit("*"), F.lit("*"), file(F.floor(k / 4)))), F.when(k % 8 == 0, row(F.lit("*"), F.lit("*"), file((k * 7 + 1) % F.col("n")))), F.when(k % 5 == 0, row(F.lit("c"), F.lit("c"), file((k * 2) % F.col("n")))),
    ))
    return declares, imports, parts.select(file(k).alias("file"), F.explode(rows).alias("r")).select("file", "r.*")


MODULES = """
  declares AS (SELECT 'm' || p_partkey AS file, 'f' || p_partkey % 40 AS name FROM part),
  imports AS (SELECT 'm' || p_partkey AS file, 'h' AS local, 'm' || p_partkey // 2 AS source, 'g' || (p_partkey // 2) % 40 AS name FROM part WHERE p_partkey % 3 = 1),
  exports AS (SELECT 'm' || p_partkey AS file, 'g' || p_partkey % 40 AS name, 'f' || p_partkey % 40 AS local, NULL AS source FROM part
    UNION ALL SELECT 'm' || p_partkey, 'a' || p_partkey % 40, 'g' || (p_partkey // 3) % 40, 'm' || p_partkey // 3 FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT 'm' || p_partkey, 'h' || p_partkey % 40, 'h', NULL FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT 'm' || p_partkey, '*', '*', 'm' || p_partkey // 4 FROM part WHERE p_partkey % 4 = 0
    UNION ALL SELECT 'm' || p_partkey, '*', '*', 'm' || (p_partkey * 7 + 1) % (SELECT count(*) FROM part) FROM part WHERE p_partkey % 8 = 0
    UNION ALL SELECT 'm' || p_partkey, 'c', 'c', 'm' || (p_partkey * 2) % (SELECT count(*) FROM part) FROM part WHERE p_partkey % 5 = 0)
"""


def edited_files(t: Tables) -> DataFrame:
    """Parts as files of functions of nine lines, in two versions: change, path, kind, old, new. Every seventh line is changed, lines of another step are removed or followed by a new one."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("int") + 5
    head = lambda i: i % 10 == 1
    line = lambda i: F.when(head(i), F.concat(F.lit("fn f"), i.cast("string"), F.lit("() {"))).otherwise(F.concat(F.lit("    item "), i.cast("string"), F.lit(" of "), k, F.lit(";")))
    edit = lambda i: F.when(~head(i) & (i % 7 == 0), F.concat(F.lit("    changed "), i.cast("string"), F.lit(";"))).when(head(i) | (i % 11 != 5), line(i))
    new = lambda i: F.when(i % 13 == 4, F.concat(F.lit("    new "), i.cast("string"), F.lit(";")))
    every = F.sequence(F.lit(1), n)
    text = lambda lines: F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    path = F.concat(F.lit("src/d"), (F.col("p_partkey") % 9).cast("string"), F.lit("/p"), k, F.lit(".rs"))
    return spread(t.part.select("p_partkey", "p_size")).select(k.alias("change"), path.alias("path"), F.lit("M").alias("kind"), text(F.transform(every, line)).alias("old"), text(F.array_compact(F.flatten(F.transform(every, lambda i: F.array(edit(i), new(i)))))).alias("new"))


EDITS = """
  numbers AS (SELECT p_partkey::VARCHAR AS change, 'src/d' || p_partkey % 9 || '/p' || p_partkey || '.rs' AS path, p_partkey AS k, unnest(range(1, p_size::INT + 6)) AS i FROM part),
  marked AS (SELECT *, i % 10 = 1 AS head, i % 10 <> 1 AND i % 7 = 0 AS changed, i % 10 <> 1 AND i % 7 <> 0 AND i % 11 = 5 AS removed, CASE WHEN i % 10 = 1 THEN 'fn f' || i || '() {' ELSE '    item ' || i || ' of ' || k || ';' END AS line FROM numbers),
  kept AS (SELECT *, sum((NOT changed AND NOT removed)::INT) OVER (PARTITION BY path ORDER BY i) AS r FROM marked),
  ops AS (SELECT change, path, i, r, ' ' AS tag, 0 AS o, line AS text FROM kept WHERE NOT changed AND NOT removed UNION ALL SELECT change, path, i, r, '-', 1, line FROM kept WHERE changed OR removed
    UNION ALL SELECT change, path, i, r, '+', 2, '    changed ' || i || ';' FROM kept WHERE changed UNION ALL SELECT change, path, i + 0.5, r, '+', 2, '    new ' || i || ';' FROM kept WHERE i % 13 = 4),
  listing AS (SELECT *, row_number() OVER w - 1 AS pos, (count(*) FILTER (tag <> '+') OVER w)::BIGINT AS old_line, (count(*) FILTER (tag <> '-') OVER w)::BIGINT AS new_line FROM ops WINDOW w AS (PARTITION BY path ORDER BY r, o, i))
"""
