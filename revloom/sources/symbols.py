"""Imports, definitions and calls of source files, as tables."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import exports, graph
from . import lexer

# What a bare specifier may stand for, in order.
SCRIPT_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
SCRIPT_INDEX = ["/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
TYPED = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}


def _normal(path: str) -> str | None:
    out: list[str] = []
    for p in path.split("/"):
        if p == "..":
            if not out:
                return None
            out.pop()
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def _script(folder: str, src: str, module: str):
    for m in re.finditer(r"""(?:\b(?:import|export)\b[^'"`;]*?\bfrom\s*|\bimport\s*\(\s*|\brequire\s*\(\s*|\bimport\s+)(['"])(\.[^'"\n]*)\1""", src):
        at = _normal(f"{folder}/{m[2]}")
        if at is None:
            continue
        ending = next((e for e in TYPED if at.endswith(e)), "")
        typed = [at[: -len(ending)] + t for t in TYPED.get(ending, [])]
        yield m[2], [at, *typed, *[at + e for e in SCRIPT_ENDINGS], *[at + e for e in SCRIPT_INDEX]]


def _python(folder: str, src: str, module: str):
    for m in re.finditer(r"(?m)^[ \t]*(?:import[ \t]+([\w.]+)|from[ \t]+(\.*)([\w.]*)[ \t]+import\b)", src):
        name, dots = m[1] or m[3] or "", len(m[2] or "")
        base = "" if not dots else _normal(folder + "/.." * (dots - 1))
        if base is None:
            continue
        at = _normal("/".join([base, *name.split(".")]))
        yield (m[2] or "") + name, [f"{at}.py", f"{at}/__init__.py"]


GO_TOKEN = re.compile(r'(?P<gap>//[^\n]*|/\*.*?(?:\*/|\Z)|\s+)|(?P<text>"(?:\\.|[^"\\\n])*"|`[^`]*`)|(?P<word>\w+)|(?P<mark>.)', re.S)


def _go_specs(src: str):
    """The import paths of a Go file by the language's grammar (X-71): declarations single or in brackets, named or not, paths quoted either way; comments are gaps. No import follows the first other declaration."""
    open_, several = False, False
    for token in GO_TOKEN.finditer(src):
        kind, got = token.lastgroup, token[0]
        if kind == "word" and got in ("const", "func", "type", "var"):
            return
        if kind == "word" and got == "import":
            open_, several = True, False
        elif open_ and kind == "text":
            yield got[1:-1]
            open_ = several
        elif open_ and got in "()":
            open_ = several = got == "("


def _go(folder: str, src: str, module: str):
    for spec in _go_specs(src):
        if module and (spec == module or spec.startswith(module + "/")):
            yield spec, [spec[len(module) + 1 :] + "/*"]


def _include(folder: str, src: str, module: str):
    for m in re.finditer(r'(?m)^\s*#\s*include\s*([<"])([^>"\n]+)[>"]', src):
        beside, shared, top = (_normal(f"{d}/{m[2]}") for d in (folder, "include", ""))
        order = [beside, shared, top] if m[1] == '"' else [top, shared, beside]
        yield m[1] + m[2], [x for x in order if x]


READERS = {"ts": _script, "py": _python, "go": _go, "c": _include}


def imports(files: DataFrame, module: str = "") -> DataFrame:
    """files(path, text) -> edges(src, dst) within the repository (SRC-23 to SRC-26, F-30, X-71, J-19): candidates in order, joined to the paths that exist; a Go package stands for its files but tests. module: the Go module's name."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text, lang in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                folder = path.rpartition("/")[0]
                seen = set()
                for spec, candidates in READERS[lang](folder, text or "", module):
                    if spec not in seen:
                        seen.add(spec)
                        rows.append((path, spec, candidates))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["src", "spec", "candidates"])

    known = files.select("path", "text", T.language(F.col("path")).alias("lang")).where("lang is not null")
    specs = known.mapInArrow(run, "src string, spec string, candidates array<string>")
    one = graph.first_match(specs.where(~F.col("candidates")[0].endswith("/*")), files)
    packages = specs.where(F.col("candidates")[0].endswith("/*")).select("src", F.regexp_replace(F.col("candidates")[0], r"^/?|/\*$", "").alias("dir"))
    members = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select(T.directory(F.col("path")).alias("dir"), F.col("path").alias("dst"))
    return one.unionByName(packages.join(members, "dir").select("src", "dst")).where("src <> dst").distinct()


def python_symbols(text: str) -> list[tuple[str, str, int, int]]:
    """(name, kind, first line, last line) with decorators (SRC-28)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def visit(node, inside: bool) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if inside else "function"
                out.append((x.name, kind, min([x.lineno, *[d.lineno for d in x.decorator_list]]), x.end_lineno))
                visit(x, isinstance(x, ast.ClassDef))
            else:
                visit(x, inside)

    visit(tree, False)
    return out


RANGES = "file string, name string, kind string, start_line int, end_line int"


def symbols(files: DataFrame) -> DataFrame:
    """files(path, text) -> (file, name, kind, start_line, end_line), lines from 1, both included (SRC-27 to SRC-29, UDF-01, UDF-04, UDF-05, X-32, X-70)."""

    def run(batches):
        for b in batches:
            rows = [(path, *g) for path, text in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True) for g in python_symbols(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()])], names=["file", "name", "kind", "start_line", "end_line"])

    return files.select("path", "text").where(T.language(F.col("path")) == "py").mapInArrow(run, RANGES).unionByName(lexer.definitions(files))


def python_calls(text: str) -> list[tuple[str, str]]:
    """(definition, name called in it), methods by their last name (X-69)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = set()
    for d in ast.walk(tree):
        if isinstance(d, ast.FunctionDef | ast.AsyncFunctionDef):
            for c in ast.walk(d):
                if isinstance(c, ast.Call):
                    name = c.func.id if isinstance(c.func, ast.Name) else c.func.attr if isinstance(c.func, ast.Attribute) else None
                    if name and name != d.name:
                        out.add((d.name, name))
    return sorted(out)


def calls(files: DataFrame) -> DataFrame:
    """(file, caller, callee) of Python files by their syntax; of others by names before a bracket on each definition's lines, a member of a plain name as `name.member` (X-69, J-21)."""

    def run(batches):
        for b in batches:
            rows = [(path, *c) for path, text in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True) for c in python_calls(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["file", "caller", "callee"])

    python = files.select("path", "text").where(T.language(F.col("path")) == "py").mapInArrow(run, "file string, caller string, callee string")
    w = Window.partitionBy("file").orderBy("pos")
    t = lexer.tokens(files).select("file", "kind", "tok", "line", *(F.lag("tok", k).over(w).alias("b" * k) for k in (1, 2, 3)), F.lead("tok").over(w).alias("after"))
    named = (F.col("kind") == "word") & (F.col("after") == "(") & ~F.col("tok").isin(*T.CONTROL_WORDS, "function", "func", "return", "super", "constructor") & ~F.coalesce("b", F.lit("")).isin("function", "func", "new")
    member = (F.col("b") == ".") & F.col("bb").rlike(r"^[\p{L}_$]") & (F.coalesce("bbb", F.lit("")) != ".")
    called = t.where(named).select("file", "line", F.when(member, F.concat("bb", F.lit("."), "tok")).otherwise(F.col("tok")).alias("callee")).distinct()
    inside = lexer.definitions(files).where("kind in ('function', 'method', 'constructor', 'getter', 'setter')")
    met = called.join(inside, "file").where("line between start_line and end_line and callee <> name")  # a file's calls and its definitions
    return python.unionByName(met.select("file", F.col("name").alias("caller"), "callee").distinct())


def linked(files: DataFrame) -> DataFrame:
    """(file, caller, callee, at_file, at_name): the definitions that calls in scripts mean, through imports, aliases and re-exports (J-21, X-32)."""
    imported, exported = lexer.module_names(files)

    def run(batches):
        for b in batches:
            rows = []
            for file, spec in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                found = list(_script(file.rpartition("/")[0], f"import '{spec}'", ""))
                rows.append((file, spec, found[0][1] if found else []))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.string(), pa.list_(pa.string())])], names=["src", "spec", "candidates"])

    specs = imported.select("file", "spec").unionByName(exported.select("file", "spec")).where("spec is not null").distinct()
    at = graph.first_match(specs.mapInArrow(run, "src string, spec string, candidates array<string>"), files, ("src", "spec")).select(F.col("src").alias("file"), "spec", F.col("dst").alias("source"))
    exported = exported.join(at, ["file", "spec"], "left").where("spec is null or source is not null").select("file", "name", "local", "source")
    imported = imported.join(at, ["file", "spec"]).select("file", "local", "source", "name")
    declares = lexer.definitions(files).where("kind in ('function', 'method')").select("file", "name")
    return exports.callees(calls(files.where(T.language(F.col("path")) == "ts")), declares, imported, exported)


#: Fixed value, which decides what counts as a definition: a name, a bracket without any of ; { }, a brace.
C_DEFINITION = r"([A-Za-z_]\w*)\s*\([^;{}]*\)\s*\{"
#: Words before a bracket and a brace that name no function.
C_NOT_FUNCTIONS = "if while for switch do else return sizeof case typeof __typeof__ asm __asm__ catch and or".split()


def c_functions(text):
    """Names that a C source defines, by pattern, wherever they stand in a line (F-31)."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(C_DEFINITION), F.lit(1))), F.array(*map(F.lit, C_NOT_FUNCTIONS)))


def definition_marks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Definitions of two versions, (file, name, header): new, gone or sig for a changed header (F-33)."""
    a, b = old.select("file", "name", F.col("header").alias("x")), new.select("file", "name", F.col("header").alias("y"))
    mark = F.when(F.col("x").isNull(), "new").when(F.col("y").isNull(), "gone").when(F.col("x") != F.col("y"), "sig")
    return a.join(b, ["file", "name"], "full_outer").select("file", "name", mark.alias("mark")).where("mark is not null")
