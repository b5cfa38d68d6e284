"""Token streams of TypeScript, JavaScript and Go, and the definitions and module names that they hold (SRC-27, SRC-29, X-32, X-70).

Strings, templates, regular expressions and comments are tokens of their own, so braces and words inside of them count as neither. Only the cutting into tokens is done by a function on a file's text; all else is done on rows: a running
sum over a file's tokens is their nesting depth, a bracket's partner is the next closing one of the same depth, and the tokens that stand directly in one pair of brackets are cut into statements where the language's rules end one. A
statement's tokens, in which everything inside of brackets is left out, are its skeleton; what it defines is read off that, and reaches from its first token to its last.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.closure import _cut

_COMMON = r"""(?P<gap>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<word>[^\W\d][\w$]*|[$#][\w$]+|\$)|(?P<number>\d[\w.]*|\.\d[\w.]*)"""
_QUOTED = r"""'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?"""
_TOKEN = {
    "ts": re.compile(_COMMON + rf"|(?P<string>{_QUOTED})|(?P<mark>=>|\?\.|\.\.\.|.)", re.S),
    "go": re.compile(_COMMON + rf"|(?P<string>`[^`]*`?|{_QUOTED})|(?P<mark>:=|\.\.\.|.)", re.S),
}
_PIECE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*(`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
# Words that no value ends with, so that a slash behind them begins a regular expression.
_NO_VALUE = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())
TOKENS = "file string, lang string, pos long, kind string, tok string, line long, end_line long"


def _tokens(source: str, lang: str, at: int = 0, inside: bool = False):
    """(kind, start, end) of all tokens but gaps. inside: of what a template embeds, up to its closing brace. A template is one token with all that it embeds."""
    last, depth = "", 0
    while at < len(source):
        start = at
        if lang == "ts" and source[at] == "`":
            while True:
                piece = _PIECE.match(source, at + 1)
                at = piece.end()
                if piece[1] != "${":
                    break
                for _, _, at in _tokens(source, lang, at, True):  # noqa: B007
                    pass
                at = min(at, len(source) - 1)  # on the closing brace
            last = "`"
            yield "string", start, max(at, start + 1)
            continue
        if lang == "ts" and source[at] == "/" and (not last or last in _NO_VALUE or not (last[-1].isalnum() or last[-1] in "_$)]'\"`")) and (m := _REGEX.match(source, at)):
            at, last = m.end(), "`"
            yield "string", start, at
            continue
        m = _TOKEN[lang].match(source, at)
        at = m.end()
        if m.lastgroup == "gap":
            continue
        last = m[0]
        depth += (last == "{") - (last == "}")
        if inside and depth < 0:
            yield "mark", start, start
            return
        yield m.lastgroup, start, at


def tokens(files: DataFrame) -> DataFrame:
    """files(path, text) -> (file, lang, pos, kind, tok, line, end_line): strings as an empty one, lines from 1."""

    def run(batches):
        for b in batches:
            for path, text, lang in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows, line, at = [], 1, 0
                for pos, (kind, start, end) in enumerate(_tokens(text or "", lang)):
                    line += text.count("\n", at, start)
                    last = line + text.count("\n", start, end)
                    rows.append((pos, kind, '""' if kind == "string" else text[start:end], line, last, text[start + 1 : end - 1] if kind == "string" else None))
                    line, at = last, end
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([lang] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["file", "lang", "pos", "kind", "tok", "line", "end_line", "said"])

    return files.select("path", "text", T.language(F.col("path")).alias("lang")).where("lang in ('ts', 'go')").mapInArrow(run, TOKENS + ", said string")


# What stands before a brace that opens an object, a type or a list of names; one behind `=>` opens a block, but goes on with its statement.
_OBJECT = [":", "|", "&", "<", ",", "=", "(", "[", "?", "return", "extends", "implements", "default", "import", "export", "type", "keyof", "...", "await", "yield", "struct", "interface", ":="]
_GOES_ON = "extends implements from as of in instanceof is satisfies".split()


def _marked(rows: DataFrame, own: Column, *marks: Column) -> DataFrame:
    """Each row with the fields of `own`, and again with those of each of `marks` that isn't null."""
    names = rows.select(own.alias("s")).schema["s"].dataType.names
    return rows.withColumn("__at", F.explode(F.array_compact(F.array(own, *marks)))).select(*(c for c in rows.columns if c not in names), *(F.col(f"__at.{c}").alias(c) for c in names))


def statements(toks: DataFrame) -> DataFrame:
    """(file, lang, around, seg, part, block, in_object, declares, head, rows): the statements of each file, a name of a list of declarations or a member of an object being one of its own. around: the position of the bracket that they stand in, null
    at the top; block, in_object: whether it is the brace of a block or of an object; declares: 1 behind const, let or var; head: their tokens with blanks between and at the end, without what stands in brackets inside of them; rows: these
    tokens with their positions and lines, and what strings say."""
    step = F.when((F.col("kind") == "mark") & F.col("tok").isin("(", "[", "{"), 1).when((F.col("kind") == "mark") & F.col("tok").isin(")", "]", "}"), -1).otherwise(0)
    t = toks.withColumn("step", step)
    t = t.withColumn("depth", F.sum("step").over(Window.partitionBy("file").orderBy("pos")) - F.least("step", F.lit(0))).withColumn("level", F.col("depth") - F.abs("step"))
    # A bracket that opens stands a second time, as a mark among what it holds, which finds it by a window there: all windows are within files, so tokens are dealt by file once and neither joined nor written.
    none = F.lit(None)
    t = _marked(t, F.struct("level", none.cast("long").alias("opens")), F.when(F.col("step") == 1, F.struct(F.col("depth").alias("level"), F.col("pos").alias("opens"))))
    around = F.last("opens", ignorenulls=True).over(Window.partitionBy("file", "level").orderBy("pos"))  # the bracket at that depth that was opened last
    t = t.withColumn("around", around).where("opens is null").drop("opens")

    w = Window.partitionBy("file", "around").orderBy("pos")
    before = lambda c, n=1: F.lag(c, n).over(w)
    t = t.withColumn("b", F.coalesce(before("tok"), F.lit(""))).withColumn("bb", F.coalesce(before("tok", 2), F.lit(""))).withColumn("b_line", before("end_line")).withColumn("b_kind", before("kind"))
    t = t.withColumn("object", (F.col("tok") == "{") & F.col("b").isin(*_OBJECT)).withColumn("goes_on", F.col("object") | (F.col("b") == "=>")).withColumn("decorates", (F.col("tok") == "(") & (F.col("bb") == "@"))
    pair = Window.partitionBy("file", "depth", F.col("step") != 0).orderBy("pos")
    closes = F.col("step") == -1
    t = t.withColumn("goes_on", F.when(closes, F.lag("goes_on").over(pair)).otherwise(F.col("goes_on"))).withColumn("decorates", F.when(closes, F.lag("decorates").over(pair)).otherwise(F.col("decorates")))
    t = t.withColumn("b_goes_on", before("goes_on")).withColumn("b_decorates", before("decorates"))

    ended = F.col("b_kind").isin("word", "number", "string") | F.col("b").isin(")", "]", "}")
    broken = (F.col("line") > F.col("b_line")) & ended
    starts = F.col("kind").isin("word", "string") & ~F.col("tok").isin(*_GOES_ON) | F.col("tok").isin("@", "*")
    decorated = (F.col("bb") == "@") | F.coalesce("b_decorates", F.lit(False))
    script = (F.col("b") == ";") | (F.col("b") == "}") & ~F.coalesce("b_goes_on", F.lit(False)) & ~F.col("tok").isin(")", ",", ";", ".", "?.") | broken & starts & ~decorated & (F.col("b") != "@")
    cut = F.when(F.col("lang") == "go", broken | (F.col("b") == ";")).otherwise(script)
    t = t.withColumn("seg", F.sum(F.when(cut, 1).otherwise(0)).over(w))
    t = t.drop("bb", "b_line", "b_kind", "b_goes_on", "b_decorates", "goes_on", "decorates")
    # names that one const, let or var declares, and members of an object, are statements of their own
    brace = F.col("tok") == "{"
    inside = F.struct(F.col("pos").alias("around"), (F.col("object") & brace).alias("in_object"), (brace & ~F.col("object")).alias("block"), F.lit(True).alias("mark"))
    t = _marked(t, F.struct("around", none.cast("boolean").alias("in_object"), none.cast("boolean").alias("block"), F.lit(False).alias("mark")), F.when(F.col("step") == 1, inside))
    t = t.withColumn("in_object", F.first("in_object").over(w)).withColumn("block", F.first("block").over(w)).where("not mark").drop("mark")  # the mark is the first in its bracket
    listed = F.max(F.when(F.col("tok").isin("const", "let", "var"), 1)).over(Window.partitionBy("file", "around", "seg").orderBy("pos")) == 1
    t = t.withColumn("listed", F.coalesce(listed, F.lit(False))).withColumn("after", F.lead("tok").over(w))
    t = t.withColumn("part", F.sum(F.when((F.col("b") == ",") & (F.col("lang") == "ts") & (F.coalesce("in_object", F.lit(False)) | F.col("listed") & (F.col("kind") == "word") & F.col("after").isin("=", ":", "!", ",", ";")), 1).otherwise(0)).over(w))
    rows = F.array_sort(F.collect_list(F.struct("pos", "tok", "line", "end_line", "said")))
    listed_at = F.max(F.when(F.col("listed"), 1).otherwise(0)).alias("declares")
    out = t.groupBy("file", "lang", "around", "seg", "part").agg(F.coalesce(F.first("block"), F.first("around").isNull()).alias("block"), F.coalesce(F.first("in_object"), F.lit(False)).alias("in_object"), listed_at, rows.alias("rows"))
    return out.withColumn("head", F.concat(F.array_join(F.transform("rows", lambda r: r["tok"]), " "), F.lit(" ")))


_NAME = r"([\p{L}_$#][\p{L}\p{N}_$]*)"
_DECORATOR = r"(?:@ [\p{L}_$][\p{L}\p{N}_$]* (?:\. [\p{L}_$][\p{L}\p{N}_$]* )*(?:\( \) )?)"
_MODIFIER = rf"(?:{_DECORATOR}|(?:export|default|declare|abstract|async|public|private|protected|static|readonly|override|accessor) )"
_VALUE = rf"(?:async )?(?:(function|class) |(?:<.*> )?\( \) (?::.*? )?(=>) |{_NAME} (=>) )"
_CONTROL = r"(?!(?:if|for|while|switch|catch|return|function|with|await|typeof|new|super|import|do|else|throw|case|constructor) )"
_TYPED = r"(?:[?!] )?(?::(?!.* => .* = (?:async )?\( \) =>).*? )??"
RANGES = "file string, name string, kind string, start_line int, end_line int"


def definitions(files: DataFrame) -> DataFrame:
    """files(path, text) -> (file, name, kind, start_line, end_line), lines from 1, both included. Scripts: functions, classes, methods, constructors, getters, setters, interfaces, enums, namespaces, and variables and properties
    that hold functions or classes, nested ones too. Go: functions, methods and types at the top."""
    s = statements(tokens(files))
    head = F.col("head")
    get = lambda pattern, k: F.nullif(F.regexp_extract(head, pattern, k), F.lit(""))
    script = F.col("lang") == "ts"
    named = F.coalesce(get(rf"^{_MODIFIER}*(?:function (?:\* )?|class ){_NAME} (?!\. )", 1), F.when(head.rlike(r"\bdefault (?:async |abstract )?(?:function|class) "), "default"))
    named = F.when(named.isin("extends", "implements"), F.when(head.rlike(r"\bdefault (?:abstract )?class "), "default")).otherwise(named)
    is_function, is_class = head.rlike(rf"^{_MODIFIER}*function (?:\* )?(?:{_NAME} )?(?:<.*> )?\( \)"), head.rlike(rf"^{_MODIFIER}*class .*\{{ \}} $")
    other = rf"^{_MODIFIER}*(?:const )?(interface|enum|namespace|module) {_NAME} .*\{{ \}} $"
    variable = rf"^(?:(?:export|declare) )*(?:(?:const|let|var) )?{_NAME} {_TYPED}= {_VALUE}"
    is_variable = (F.col("declares") == 1) & head.rlike(variable)
    of_value = F.when(get(variable, 2) == "class", "class").otherwise("function")

    # the bracket of a class, and that of a group of types, as marks among the statements in it
    class_at = F.when(script & ((F.col("block") & is_class) | head.rlike(r"= (?:abstract )?class .*\{ \}")), F.try_element_at(F.filter("rows", lambda r: r["tok"] == "{"), F.lit(-1))["pos"])
    group_at = F.when((F.col("lang") == "go") & F.col("around").isNull() & head.rlike(r"^type \( \) "), F.get("rows", 1)["pos"])
    of = lambda at, in_class, of_types, mark: F.struct(at.alias("around"), F.lit(in_class).alias("in_class"), F.lit(of_types).alias("of_types"), F.lit(mark).alias("mark"))
    s = _marked(s, of(F.col("around"), False, False, False), *(F.when(at.isNotNull(), of(at, at is class_at, at is group_at, True)) for at in (class_at, group_at)))
    w = Window.partitionBy("file", "around")
    s = s.withColumn("in_class", F.max("in_class").over(w)).withColumn("of_types", F.max("of_types").over(w)).where("not mark").drop("mark")
    method = rf"^{_MODIFIER}*(?:(get|set) )?(?:\* )?{_CONTROL}{_NAME} (?:[?!] )?(?:<.*> )?\( \) "
    builder = r"^(?:(?:public|private|protected) )*constructor \( \) "
    held = rf"^{_MODIFIER}*{_NAME} {_TYPED}= {_VALUE}"
    is_method = (F.col("in_class") & head.rlike(method)) | (F.col("in_object") & head.rlike(method + r"(?::.* )?\{ \} (?:, )?$"))
    go_type = get(rf"^type {_NAME} ", 1)
    go_function = rf"^func (\( \) )?{_NAME} (?:\[ \] )?\( \) "
    top = (F.col("lang") == "go") & F.col("around").isNull()

    def found(name: Column, kind, skip=None):  # skip: the name of the first token that counts
        return F.struct(name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(None).cast("string") if skip is None else skip).alias("begin"))

    what = (
        F.when(script & F.col("in_class") & head.rlike(builder), found(F.lit("constructor"), "constructor"))
        .when(script & is_method, found(get(method, 2), F.when(get(method, 1) == "get", "getter").when(get(method, 1) == "set", "setter").otherwise("method")))
        .when(script & F.col("in_class") & head.rlike(held), found(get(held, 1), F.when(get(held, 2) == "class", "class").otherwise("function")))
        .when(script & F.col("block") & ~F.col("in_class") & is_function & named.isNotNull(), found(named, "function"))
        .when(script & F.col("block") & ~F.col("in_class") & is_class & named.isNotNull(), found(named, "class"))
        .when(script & F.col("block") & ~F.col("in_class") & head.rlike(other), found(get(other, 2), F.when(get(other, 1) == "module", "namespace").otherwise(get(other, 1))))
        .when(script & ~F.col("in_object") & ~F.col("in_class") & is_variable, found(get(variable, 1), of_value, get(variable, 1)))
        .when(top & head.rlike(go_function), found(get(go_function, 2), F.when(get(go_function, 1).isNull(), "function").otherwise("method")))
        .when(top & go_type.isNotNull(), found(go_type, "type", go_type))
        .when((F.col("lang") == "go") & F.col("of_types") & head.rlike(rf"^{_NAME} "), found(get(rf"^{_NAME} ", 1), "type"))
    )
    d = s.withColumn("d", what).where("d is not null")
    rest = F.filter("rows", lambda r: ~r["tok"].isin(";", ",") | F.col("in_class"))
    first = F.when(F.col("d.begin").isNull(), F.get("rows", 0)).otherwise(F.get(F.filter("rows", lambda r: r["tok"] == F.col("d.begin")), 0))
    return _cut(d.select("file", "d.name", "d.kind", first["line"].cast("int").alias("start_line"), F.try_element_at(rest, F.lit(-1))["end_line"].cast("int").alias("end_line")))  # of all that was made, only the ranges are written


def module_names(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What scripts import, (file, local, spec, name), and export, (file, name, local, spec): the rows that exports.resolve takes, with specifiers in place of files."""
    toks = tokens(files).where("lang = 'ts'")
    s = _cut(statements(toks).where("around is null")).withColumn("head", F.regexp_replace("head", f"^{_DECORATOR}+", "")).where("head rlike '^(import|export) '")
    # the names in braces are the statements of their own brackets; a brace's are joined back to where it stands
    lists = F.try_element_at(F.filter("rows", lambda r: r["tok"] == "{"), F.lit(1))["pos"]
    spec = F.try_element_at(F.filter("rows", lambda r: r["said"].isNotNull()), F.lit(-1))["said"]
    has_from = F.col("head").rlike(r' from "" ')
    top = s.select("file", "head", lists.alias("opens"), F.when(has_from, spec).alias("spec"))
    w = Window.partitionBy("file").orderBy("pos")
    marked = toks.withColumn("opens", F.last(F.when(F.col("tok") == "{", F.col("pos")), ignorenulls=True).over(w)).withColumn("next", F.lead("tok").over(w)).withColumn("next2", F.lead("tok", 2).over(w)).withColumn("b", F.lag("tok").over(w)).withColumn("bb", F.lag("tok", 2).over(w))
    entry = marked.where((F.col("kind") == "word") & ((F.col("b").isin("{", ",")) | (F.col("b") == "type") & F.col("bb").isin("{", ",")) & F.col("next").isin("}", ",", "as"))
    entry = entry.select("file", "opens", F.col("tok").alias("one"), F.when(F.col("next") == "as", F.col("next2")).otherwise(F.col("tok")).alias("alias"))
    get = lambda pattern, k=1: F.nullif(F.regexp_extract("head", pattern, k), F.lit(""))
    none = F.lit(None).cast("string")
    imported, exported = top.where("head like 'import %' and spec is not null"), top.where("head like 'export %'")
    default = get(rf"^import (?:type (?!from |, ))?{_NAME} (?:, |from )")
    space = get(rf"\* as {_NAME} from ")
    imports = imported.where(default.isNotNull()).select("file", default.alias("local"), "spec", F.lit("default").alias("name"))
    imports = imports.unionByName(imported.where(space.isNotNull()).select("file", space.alias("local"), "spec", F.lit("*").alias("name")))
    imports = imports.unionByName(imported.where(F.col("opens").isNotNull()).join(entry, ["file", "opens"]).select("file", F.col("alias").alias("local"), "spec", F.col("one").alias("name")))
    stars = exported.where("head rlike '^export (type )?[*] '").select("file", F.coalesce(space, F.lit("*")).alias("name"), F.lit("*").alias("local"), "spec")
    braces = exported.where("head rlike '^export (type )?[{] '").join(entry, ["file", "opens"]).select("file", F.col("alias").alias("name"), F.col("one").alias("local"), "spec")
    own = get(rf"^export (?:declare |abstract |async )*(?:const )?(?:function (?:\* )?|class |interface |enum |type |namespace |module |const |let |var ){_NAME} ")
    plain = exported.where(own.isNotNull()).select("file", own.alias("name"), own.alias("local"), none.alias("spec"))
    main = F.coalesce(get(rf"^export default (?:async |abstract )*(?:function (?:\* )?|class )(?!extends |implements ){_NAME} "), get(rf"^export default (?!async |abstract |function |class |new |await ){_NAME} (?:; )?$"), F.lit("default"))
    mains = exported.where("head like 'export default %'").select("file", F.lit("default").alias("name"), main.alias("local"), none.alias("spec"))
    return imports, stars.unionByName(braces).unionByName(plain).unionByName(mains)
