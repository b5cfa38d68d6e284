"""Column functions over source text, paths and messages; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token kinds of a source line, in order of preference.
TOKEN = r'(?s)\s+|[_\p{L}][_\p{L}\p{N}]*|(?:[0-9]|\.[0-9])[\p{L}\p{N}._]*|"(?=.*")(?:\\.?|[^"\\])*"?|[<>=!&|^~+*/%-]+|.'
# Operators whose flip changes the meaning of a line.
FLIP_OPERATORS = ["==", "!=", "<", "<=", ">", ">=", "&&", "||", "!"]
# Words that carry no domain meaning.
STOPWORDS = (
    "the and for not let var const func function def fun return class struct enum impl trait interface type import export from package "
    "public private protected static async await yield new this self super null nil none true false void int str bool string number float double char byte "
    "else elif while match case switch break continue default try catch except finally throw raise with use using namespace extends implements override abstract final "
    "get set add put map list vec arr obj val value data item key idx len tmp res req err out buf ctx cfg args opts name size kind text line path file call"
).split()
# Names too common to tie two files together.
COMMON_NAMES = (
    "index default setup config options params result error errors response request status state store props context session client server service handler manager factory builder "
    "controller model view component widget module record entry event message value values items types utils helper helpers common constants schema router route routes logger metadata payload wrapper adapter"
).split()
MEMBER_KINDS = "method constructor getter setter field property variable parameter accessor".split()
# What shows each class of operation, sought in lower-cased text.
PATTERNS = {
    "schema-create": ["create table", "createtable", "migrat", "alter table", "altercolumn", "add column", "schema", "create index", "createindex", "uuidv7", "auto-increment", "autoincrement"],
    "db-query": [".query(", ".where(", "select ", "findmany", "findunique", "queryraw", "keyset", "pagination", "order by", "orderby"],
    "external-call": ["fetch(", "axios", "http", ".send(", ".post(", "gateway.", "provider.", "enqueue", "analytics", "emailservice", "webhook", "requests.", "urllib", "i18n.render", "smsprovider"],
    "money": ["cents", "price", "money", "invoice", "currency", "monetary", "taxrate", "tax_rate", "salestax", "regionaltax"],
}
SOURCE_EXTENSIONS = "ts tsx js jsx mjs cjs mts cts c h cc cpp cxx hh hpp hxx py pyi go".split()
LANGUAGES = {"ts": "ts tsx js jsx mjs cjs mts cts", "c": "c h cc cpp cxx hh hpp hxx", "py": "py pyi", "go": "go"}
PARSED_EXTENSIONS = "ts tsx mts cts js jsx mjs cjs py go".split()
CONTROL_WORDS = "if else elif for while loop match switch case do try catch finally when unless begin with foreach".split()
MODIFIERS = ["pub(crate)", "pub", "async", "export", "default", "static", "public", "private", "protected", "final", "unsafe", "const", "abstract"]
DEFINITIONS = "fn function def func class struct trait impl interface enum mod type".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def epoch_seconds(name: str) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name).cast("timestamp_ntz"))


def any_of(c: Column, tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


# Lines of source, as shapes (F-01 to F-05, FLT-09)


def lines(text: Column) -> Column:
    """The lines of a text: a last line break ends the last line, a carriage return before a break goes."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(whole, "\n"), lambda x: F.regexp_replace(x, r"\r\z", "")))


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(TOKEN), F.lit(0))


def is_string(t: Column) -> Column:
    return (F.length(t) > 1) & t.startswith('"')


def is_number(t: Column) -> Column:
    return t.rlike(r"^(?:[0-9]|\.[0-9])")


def is_flip(t: Column) -> Column:
    return t.isin(FLIP_OPERATORS)


def _mask(t: Column) -> Column:
    return F.when(t.rlike(r"^\s"), " ").when(t.rlike(r"^[_\p{L}]"), "_").when(is_number(t), "#").when(is_string(t), '""').otherwise(t)


def mask_shape(line: Column) -> Column:
    """A line with identifiers, numbers and strings masked and white space collapsed."""
    return F.trim(F.array_join(F.transform(tokens(line), _mask), ""))


def operator_shape(line: Column) -> Column:
    """The same with flip operators masked too."""
    return F.trim(F.array_join(F.transform(tokens(line), lambda t: F.when(is_flip(t), "∘").otherwise(_mask(t))), ""))


def operators(line: Column) -> Column:
    return F.filter(tokens(line), is_flip)


def literals(line: Column) -> Column:
    """Numbers and strings (with their quotes) in order."""
    return F.filter(tokens(line), lambda t: is_number(t) | is_string(t))


def numeric_literals(line: Column) -> Column:
    return F.filter(tokens(line), is_number)


# Words and classes of a text (F-06 to F-09, FLT-07, FLT-08)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def split_identifier(name: Column) -> Column:
    """The lower-cased words of an identifier, parted at _ and where a capital follows a small letter or digit."""
    return F.filter(F.split(ascii_lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_")), "_"), lambda w: w != "")


def is_salient(word: Column) -> Column:
    return (F.octet_length(word) >= 3) & ~word.isin(STOPWORDS)


def symbols(text: Column) -> Column:
    """The sorted distinct salient words of a text's identifiers."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(identifiers(text), split_identifier)), is_salient)))


def patterns(text: Column) -> Column:
    """The sorted classes of operation that a text shows."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(any_of(low, [F.contains(low, F.lit(s)) for s in PATTERNS[k]]), F.lit(k)) for k in sorted(PATTERNS)]))


def is_distinctive(name: Column, kind: Column) -> Column:
    return ~kind.isin(MEMBER_KINDS) & ~name.startswith("_") & (F.length(name) >= 5) & ~ascii_lower(name).isin(COMMON_NAMES)


# Redaction (F-10 to F-14)

BODY = "[A-Za-z0-9_-]"
START = rf"(?<!{BODY})"
# Prefixes of credentials and the least length of what follows.
PREFIXES = [("ghp_", 36), ("gho_", 36), ("ghu_", 36), ("ghs_", 36), ("ghr_", 36), ("github_pat_", 20), ("glpat-", 20), ("AIza", 35), ("xoxb-", 10), ("xoxa-", 10), ("xoxp-", 10), ("xoxr-", 10), ("xoxs-", 10)]
SECRET = START + "(?:" + "|".join([rf"sk-(?={BODY}*[A-Z])(?={BODY}*[0-9]){BODY}{{20,}}+", *[rf"{p}{BODY}{{{n},}}+" for p, n in PREFIXES], rf"A(?:K|S)IA[A-Z0-9]{{16}}(?!{BODY})"]) + ")"
JWT = START + rf"eyJ{BODY}{{9,}}+\.{BODY}{{8,}}+\.{BODY}{{8,}}+"
PEM = r"(?s)-----BEGIN [^\n]*PRIVATE KEY[^\n]*\n.*?-----END [^\n]*(?:\n|\z)"
PEM_CUT = r"(?s)-----BEGIN [^\n]*PRIVATE KEY[^\n]*\n(?!.*-----END )(?:(?!\n\n).){0,8192}\n?"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?=[A-Za-z0-9])[A-Za-z0-9.-]*\.[A-Za-z]{2,}(?=[.-]*(?:[^A-Za-z0-9.-]|$))"

# The same as a whole run of the characters of addresses only: `a@b.co@c` and `a@b.co_x` hold none.
EMAIL_RUN = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}(?=[.-]*(?:[^A-Za-z0-9._%+@-]|\z))"


def scrub_secrets(text: Column) -> Column:
    """Private keys, tokens of known shape and signed tokens replaced by marks."""
    for rx, mark in ((PEM, "[REDACTED-PRIVATE-KEY]"), (PEM_CUT, "[REDACTED-PRIVATE-KEY]"), (SECRET, "[REDACTED-SECRET]"), (JWT, "[REDACTED-JWT]")):
        text = F.regexp_replace(text, rx, mark)
    return text


def count_secrets(text: Column) -> Column:
    """How many redactions scrub_secrets makes."""
    n = lambda s: F.regexp_count(F.coalesce(s, F.lit("")), F.lit(r"\[REDACTED-(?:PRIVATE-KEY|SECRET|JWT)\]"))
    return n(scrub_secrets(text)) - n(text)


def scrub_emails(text: Column, pattern: str = EMAIL) -> Column:
    return F.regexp_replace(text, pattern, "[REDACTED-EMAIL]")


def count_emails(text: Column, pattern: str = EMAIL) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


# Tasks, messages, definitions (F-16, F-17, F-26 to F-29, F-32, F-34, X-11, X-12)


def first_line(text: Column) -> Column:
    """The first line, trimmed; of more than 200 characters, the first 199 and an ellipsis."""
    t = F.trim(F.split(F.coalesce(text, F.lit("")), "\n")[0])
    return F.when(F.length(t) > 200, F.concat(F.substring(t, 1, 199), F.lit("…"))).otherwise(t)


def definition(line: Column) -> Column:
    """Keyword and name if the line opens a definition, else null."""
    mods = "|".join(m.replace("(", r"\(").replace(")", r"\)") for m in MODIFIERS)
    rx = rf"^\s*(?:(?:{mods}) \s*)*((?:{'|'.join(DEFINITIONS)}) )\s*([\p{{L}}\p{{N}}_]+)"
    return F.when(line.rlike(rx), F.concat(F.regexp_extract(line, rx, 1), F.regexp_extract(line, rx, 2)))


def is_control_opener(line: Column) -> Column:
    return line.rlike(rf"^\s*(?:\}}|(?:{'|'.join(CONTROL_WORDS)})(?![\p{{L}}\p{{N}}_]))")


def relative_time(ts: Column, now: Column) -> Column:
    d = F.greatest(now - ts, F.lit(0))
    say = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    return F.when(ts == 0, "unknown time").when(d < 60, say(d, "s ago")).when(d < 3600, say(F.floor(d / 60), "m ago")).when(d < 86400, say(F.floor(d / 3600), "h ago")).otherwise(say(F.floor(d / 86400), "d ago"))


def duration(seconds: Column) -> Column:
    s = lambda n, unit: F.concat(F.floor(n).cast("long").cast("string"), F.lit(unit))
    h, m = seconds / 3600, (seconds % 3600) / 60
    return F.when(h >= 1, F.concat(s(h, "h"), s(m, "m"))).when(m >= 1, F.concat(s(m, "m"), s(seconds % 60, "s"))).otherwise(s(seconds % 60, "s"))


def error_kind(message: Column) -> Column:
    m = F.lower(message)
    has = lambda *x: any_of(m, [F.contains(m, F.lit(s)) for s in x])
    return F.when(has("history yet", "commit first"), "no_history").when(has("not a git repo", "not a repo"), "not_a_repo").when(has("usage:"), "usage").when(has("no such", "not found", "does not exist"), "not_found").otherwise("error")


def author(header: Column) -> Column:
    """Who and when of an author header: struct(who, ts)."""
    gt = F.regexp_extract(header, r"(?s)^(.*>)", 1)
    rest = F.regexp_extract(header, r"(?s)^.*>\s*(\d+)(?:\s|$)", 1)
    return F.struct(F.when(header.isNull(), "unknown").when(gt != "", F.trim(gt)).otherwise(F.trim(header)).alias("who"), F.coalesce(F.expr("0L") + F.when(rest != "", rest.cast("long")), F.lit(0)).alias("ts"))


def tokens_by_bytes(text: Column) -> Column:
    return F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def tokens_by_chars(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def size_of(text: Column) -> Column:
    """Bytes of a size such as 64k, 2MiB or 1g; null for junk and for 0."""
    rx = r"(?i)^\s*\+?(\d{1,18})\s*([kmgt]?)i*b*\s*$"
    unit = F.lower(F.regexp_extract(text, rx, 2))
    factor = F.when(unit == "k", F.lit(1 << 10)).when(unit == "m", F.lit(1 << 20)).when(unit == "g", F.lit(1 << 30)).when(unit == "t", F.lit(1 << 40)).otherwise(F.lit(1)).cast("decimal(38,0)")
    n = F.when(text.rlike(rx), F.least(F.regexp_extract(text, rx, 1).cast("decimal(38,0)") * factor, F.lit((1 << 63) - 1).cast("decimal(38,0)"))).cast("long")
    return F.when(n > 0, n)


def detect_tool(path: Column, text: Column) -> Column:
    return F.when(path.endswith(".jsonl") | text.rlike(r'"type": ?"assistant"'), "lines").when(F.contains(path, F.lit("aider")) | path.endswith(".md"), "markdown").otherwise("lines")


def message_text(content: Column) -> Column:
    """The visible text of a message's JSON content: a string, or the blocks of type text joined by a space."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), " ")
    plain = F.from_json(F.concat(F.lit('{"s":'), content, F.lit("}")), "struct<s:string>")["s"]
    return F.when(content.startswith("["), F.when(joined != "", joined)).when(content.startswith('"'), plain)


# Paths (F-23 to F-25, FLT-04 to FLT-06, FLT-15, FLT-16, J-16, X-36)


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kinds in LANGUAGES.items():
        out = F.when(extension(path).isin(kinds.split()), name).otherwise(out)
    return out


def is_source(path: Column) -> Column:
    return path.rlike(rf"\.(?:{'|'.join(SOURCE_EXTENSIONS)})$") & ~path.rlike(r"\.d\.[mc]?ts$")


def is_ignored_path(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda c: c.startswith(".") | c.isin("node_modules", "dist", "build"))


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    base = F.element_at(F.split(low, "/"), -1)
    stem = F.split(base, r"\.")[0]
    return F.exists(F.split(low, "/"), lambda p: p.isin("test", "tests", "spec", "__tests__")) | base.rlike(r"\.(?:test|spec)\.") | stem.rlike("^(?:test|spec)_|_(?:test|spec)$")


def stem(path: Column) -> Column:
    return F.split(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.")[0]


def covered_stems(path: Column) -> Column:
    """The stems of sources that a test of this path may cover: its own, and it without one affix."""
    s = stem(path)
    return F.array_distinct(F.array_compact(F.array(s, *[F.when(s.rlike(rx), F.regexp_replace(s, rx, "")) for rx in ("_test$", "_spec$", "^test_", "^spec_")])))


def is_safe_name(name: Column) -> Column:
    return (name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\\x00]")


def is_parsed(path: Column) -> Column:
    return extension(path).isin(PARSED_EXTENSIONS)


def glob_prefix(glob: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(glob, r"/?\*+$", ""), "/$", "")


def globs_collide(a: Column, b: Column) -> Column:
    """Whether one of two globs' prefixes holds the other; an empty prefix claims everything."""
    x, y = glob_prefix(a), glob_prefix(b)
    return (x == "") | (y == "") | (x == y) | x.startswith(F.concat(y, F.lit("/"))) | y.startswith(F.concat(x, F.lit("/")))


def ancestors_of(path: Column) -> Column:
    """Every directory above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))
