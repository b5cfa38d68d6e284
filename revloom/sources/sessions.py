"""Work sessions of transcripts, chat histories and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LINE = "type string, message struct<model:string,usage:struct<input_tokens:bigint,output_tokens:bigint>,content:string>"
SESSION = "task string, model string, lesson string, prompts string, context_served string, tool_calls array<string>, tool_results array<string>, verification string, tokens_in bigint, tokens_out bigint"


def from_lines(lines: DataFrame) -> DataFrame:
    """lines(session, seq, value) of JSON transcripts -> (session, task, model, tokens_in, tokens_out, tool_calls): the first user text, the last model, token sums, tools in order of first use; lines that aren't JSON are left out (SRC-19)."""
    x = lines.select("session", "seq", F.from_json("value", LINE).alias("d")).select("session", "seq", "d.type", "d.message.*")
    text = F.when(F.col("type") == "user", T.message_text(F.col("content")))
    plain = F.when((F.col("type") == "user") & F.col("content").isNotNull() & ~F.col("content").rlike(r"^\s*\["), F.col("content"))
    said = F.coalesce(text, plain)
    main = x.groupBy("session").agg(
        F.min_by(said, F.when(said.isNotNull() & (said != ""), F.col("seq"))).alias("task"), F.max_by("model", F.when(F.col("model") != "", F.col("seq"))).alias("model"),
        F.coalesce(F.sum("usage.input_tokens"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("usage.output_tokens"), F.lit(0)).alias("tokens_out"),
    )
    blocks = x.where(F.col("content").startswith("[")).select("session", "seq", F.posexplode(F.from_json("content", "array<struct<type:string,name:string>>")).alias("at", "b"))
    tools = blocks.where("b.type = 'tool_use' and b.name is not null").groupBy("session", "b.name").agg(F.min(F.struct("seq", "at")).alias("first"))
    listed = tools.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda t: t["name"]).alias("tool_calls"))
    out = main.join(listed, "session", "left")
    return out.select("session", T.first_line(F.col("task")).alias("task"), F.coalesce("model", F.lit("")).alias("model"), "tokens_in", "tokens_out", F.coalesce("tool_calls", F.array().cast("array<string>")).alias("tool_calls"))


def from_markdown(files: DataFrame) -> DataFrame:
    """files(session, text): the first line headed #### , else the first that isn't blank (SRC-20)."""
    head = F.regexp_extract("text", r"(?m)^#### (.*)$", 1)
    first = F.regexp_extract("text", r"(?m)^\s*(\S.*?)\s*$", 1)
    task = F.when(F.col("text").rlike(r"(?m)^#### "), F.trim(head)).otherwise(F.trim(first))
    return files.select("session", T.first_line(task).alias("task"), F.lit("").alias("model"), F.lit(0).cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"))


def from_json(rows: DataFrame, scrub: bool = True, pii: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows(id, value, message): sessions with payloads as ids, and the payloads(id, role, at, text) they stand for; texts are scrubbed before they get ids (SRC-21, X-10, X-18, X-19, F-15)."""
    x = rows.select("id", "message", F.from_json("value", SESSION).alias("s"))
    clean = lambda c: (T.scrub_emails(T.scrub_secrets(c)) if pii else T.scrub_secrets(c)) if scrub else c
    many = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), clean)
    full = x.select(
        "id", clean(F.coalesce("s.task", "message")).alias("task"), F.coalesce("s.model", F.lit("unknown")).alias("model"), clean(F.coalesce("s.lesson", F.lit(""))).alias("lesson"),
        clean(F.nullif("s.prompts", F.lit(""))).alias("prompts"), clean(F.nullif("s.context_served", F.lit(""))).alias("context_served"), many(F.col("s.tool_calls")).alias("tool_calls"), many(F.col("s.tool_results")).alias("tool_results"),
        F.when(F.col("s.verification").isin("green", "red"), F.col("s.verification")).otherwise("unverified").alias("verification"), F.coalesce("s.tokens_in", F.lit(0)).alias("tokens_in"), F.coalesce("s.tokens_out", F.lit(0)).alias("tokens_out"),
    )
    one = lambda role: F.when(F.col(role).isNotNull(), F.array(F.struct(F.lit(role).alias("role"), F.lit(0).alias("at"), F.col(role).alias("text")))).otherwise(F.array())
    several = lambda role: F.transform(role, lambda t, k: F.struct(F.lit(role).alias("role"), k.alias("at"), t.alias("text")))
    kind = "array<struct<role:string,at:int,text:string>>"
    payloads = full.select("id", F.explode(F.concat(*[p.cast(kind) for p in (one("prompts"), one("context_served"), several("tool_calls"), several("tool_results"))])).alias("p")).select("id", "p.*").withColumn("payload_id", F.sha2("text", 256))
    ids = lambda c: F.when(F.col(c).isNotNull(), F.sha2(c, 256)).alias(c)
    lists = lambda c: F.transform(c, lambda t: F.sha2(t, 256)).alias(c)
    sessions = full.select("id", "task", "model", "lesson", ids("prompts"), ids("context_served"), lists("tool_calls"), lists("tool_results"), "verification", "tokens_in", "tokens_out")
    return sessions, payloads


def payload_status(payloads: DataFrame, opened: DataFrame) -> DataFrame:
    """payloads(id, payload_id) against opened(id, status): by session, intact, all or some erased (AGG-21)."""
    o = opened.select(F.col("id").alias("payload_id"), "status")
    x = payloads.join(o, "payload_id", "left").groupBy("id").agg(F.bool_and(F.col("status") == "shredded").alias("all"), F.bool_or(F.col("status") == "shredded").alias("some"))
    return x.select("id", F.when(F.col("all"), "all erased").when(F.col("some"), "some erased").otherwise("intact").alias("status"))


def policy(defaults: dict, stored: dict | None, flags: dict) -> list[tuple[str, object, str]]:
    """(setting, value, source): flags before the stored policy before defaults (X-13, X-14, X-61)."""
    out = []
    for name in sorted({*defaults, *(stored or {}), *flags}):
        layers = [("flag", flags.get(name)), ("policy", (stored or {}).get(name)), ("default", defaults.get(name))]
        source, value = next(((s, v) for s, v in layers if v is not None), ("default", None))
        out.append((name, value, source))
    return out
