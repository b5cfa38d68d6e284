"""Definitions and module names of scripts and Go files, with braces and words inside of strings, templates, regular expressions and comments."""

import pytest

from revloom.sources import lexer, symbols

SCRIPT = """\
import main, { a, b as c, type D } from './lib';
import * as ns from "../space";
import type { E } from './types';
import './effect';
export * from './all';
export * as inner from './inner';
export { a, c as renamed } from './lib';
export { f as default, g };
export type { E };
// function commented() { {{
/* class Commented { */
const text = "function quoted() { {", more = 'it\\'s } {';
const t = `a ${ [1, 2].map((x) => `n ${x} }`) } } { function no() {`;
const pattern = /[{/]\\/{+/g.test(text) ? 4 / 2 : 1 / 3;
export function f(a: { x: number }): { y: string } {
  if (a) { return { y: `}${a.x}` }; }
  function nested() { return 1; }
  return { y: "" };
}
export const g = async <T,>(x: T): Promise<T> => {
  return x;
}
const one = 1, two = (x) => x + 1,
  three = function () {
    return 3;
  };
function overload(a: string): void;
function overload(a: any): void {
}
@dec({ a: 1 })
@other
export abstract class Klass<T, U> extends Base<{ z: 1 }> implements I {
  private readonly x: number = 1;
  handler = (e) => {
    this.x = e;
  };
  constructor(private a = {}) {
    super();
  }
  get size(): number { return 1; }
  static set size(v) { }
  async *items<V>(a: V): AsyncGenerator<V> {
    if (a) { call(a); }
    for (const q of a) { }
  }
  abstract missing(): void;
  #secret() { return { if() { return 1; } }; }
}
interface Shape {
  area(): number;
}
const enum Color { Red, Green }
declare namespace Deep { const v: number; }
const Named = class { run() { } };
const obj = { m() { return 1; }, p: 1, get v() { return 2; } };
export default class { }
"""

GO = """\
package m

import ("fmt"; x "y")

// func commented() {
type Point struct {
	X, Y int // }
}

type (
	ID = string
	Pair[T any] struct {
		a, b T
	}
	F func(a int) (b int)
)

var s = `raw { "
func no() {`

func (p *Point) Move(dx int, f func() struct{ a int }) (x, y int) {
	type local struct{ a int }
	g := func(a int) { fmt.Println("}") }
	r := '{'
	return
}

func Map[T, U any](in []T) []U { return nil }
func external(a int) int
type Last interface { Do() }
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("s.ts", SCRIPT), ("m.go", GO), ("empty.ts", ""), ("none.go", None), ("broken.ts", "function f() { class A { ( `${ {"), ("x.py", "def f(): pass"), ("closed.ts", ") } ] function z() {}")], "path string, text string")


def test_definitions(files):
    got = {(r.file, r.name, r.kind, r.start_line, r.end_line) for r in lexer.definitions(files).collect()}
    of = lambda f: sorted(((a, b, c, d) for x, a, b, c, d in got if x == f), key=lambda r: (r[2], r[3], r[0]))
    line = lambda what, n=0: [k + 1 for k, x in enumerate(SCRIPT.split("\n")) if what in x][n]
    want = [
        ("f", "function", 15, 19), ("nested", "function", 17, 17), ("g", "function", 20, 22), ("two", "function", 23, 23), ("three", "function", 24, 26), ("overload", "function", 27, 27), ("overload", "function", 28, 29),
        ("Klass", "class", line("@dec"), line("#secret") + 1), ("handler", "function", line("handler"), line("handler") + 2), ("constructor", "constructor", line("constructor"), line("constructor") + 2), ("size", "getter", line("get size"), line("get size")),
        ("size", "setter", line("set size"), line("set size")), ("items", "method", line("*items"), line("*items") + 3), ("missing", "method", line("missing"), line("missing")), ("#secret", "method", line("#secret"), line("#secret")),
        ("Shape", "interface", line("interface"), line("interface") + 2), ("Color", "enum", line("enum"), line("enum")), ("Deep", "namespace", line("Deep"), line("Deep")), ("Named", "class", line("Named"), line("Named")), ("run", "method", line("Named"), line("Named")),
        ("m", "method", line("const obj"), line("const obj")), ("v", "getter", line("const obj"), line("const obj")), ("default", "class", line("export default"), line("export default")),
    ]
    assert of("s.ts") == sorted(want, key=lambda r: (r[2], r[3], r[0]))
    assert of("m.go") == [("Point", "type", 6, 8), ("ID", "type", 11, 11), ("Pair", "type", 12, 14), ("F", "type", 15, 15), ("Move", "method", 21, 26), ("Map", "function", 28, 28), ("external", "function", 29, 29), ("Last", "type", 30, 30)]
    assert not of("empty.ts") and not of("x.py") and not of("none.go")


def test_module_names(files):
    imports, exported = lexer.module_names(files)
    assert {tuple(r) for r in imports.where("file = 's.ts'").select("local", "spec", "name").collect()} == {
        ("main", "./lib", "default"), ("a", "./lib", "a"), ("c", "./lib", "b"), ("D", "./lib", "D"), ("ns", "../space", "*"), ("E", "./types", "E"),
    }
    assert {tuple(r) for r in exported.where("file = 's.ts'").select("name", "local", "spec").collect()} == {
        ("*", "*", "./all"), ("inner", "*", "./inner"), ("a", "a", "./lib"), ("renamed", "c", "./lib"), ("default", "f", None), ("g", "g", None), ("E", "E", None), ("f", "f", None), ("g", "g", None), ("Klass", "Klass", None), ("default", "default", None),
    }


def test_linked(spark):
    files = spark.createDataFrame([
        ("src/a.ts", "export function f() { return g(); }\nfunction g() {}\nexport { g as shown };"), ("src/index.ts", "export * from './a';\nexport { f as run } from './a.js';\nexport * as box from './b';"),
        ("src/b.ts", "export const h = () => 1;\nexport default function () {}\nexport class K { m() {} }"),
        ("main.ts", "import { run, shown as s, box } from './src';\nimport d, * as ns from './src/b';\nfunction go() {\n  run(); s(); box.h(); ns.h(); d(); print(ns.none()); `${run()}`;\n}"), ("x.py", "def p():\n    q()"),
    ], "path string, text string")
    got = sorted(tuple(r) for r in symbols.linked(files).collect())
    assert got == [
        ("main.ts", "go", "box.h", "src/b.ts", "h"), ("main.ts", "go", "d", "src/b.ts", "default"), ("main.ts", "go", "ns.h", "src/b.ts", "h"), ("main.ts", "go", "run", "src/a.ts", "f"), ("main.ts", "go", "s", "src/a.ts", "g"), ("src/a.ts", "f", "g", "src/a.ts", "g"),
    ]
    assert {("main.ts", "go", "print"), ("x.py", "p", "q")} <= {tuple(r) for r in symbols.calls(files).collect()}


def test_definitions_cut_texts_into_tokens_once(spark, monkeypatch):
    """the joins of tokens and statements with themselves don't repeat the plan below them."""
    from revloom.sources import lexer

    calls = []
    monkeypatch.setattr(lexer, "_cut", lambda df, cut=lexer._cut: calls.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")) or cut(df))
    files = spark.createDataFrame([("a.ts", "class C {\n  m() {}\n}\n"), ("b.go", "package b\nfunc F() {\n}\n")], "path string, text string")
    found = lexer.definitions(files)
    assert sum(calls) == 1 and "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.file, r.name, r.kind) for r in found.collect()} == {("a.ts", "C", "class"), ("a.ts", "m", "method"), ("b.go", "F", "function")}


def test_definitions_are_dealt_by_file_once(spark, monkeypatch):
    """nothing is joined, so no table of brackets or classes can be broadcast, and one shuffle by file is all."""
    plans = []
    monkeypatch.setattr(lexer, "_cut", lambda df, cut=lexer._cut: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    files = spark.createDataFrame([("a.ts", "class A {\n  m() {\n    return { n() { } };\n  }\n}\n"), ("b.go", "package b\ntype (\n\tT struct {\n\t\tX int\n\t}\n\tU int\n)\nfunc f() {\n}\n")], "path string, text string")
    found = {tuple(r)[1:] for r in lexer.definitions(files).collect()}
    assert found == {("A", "class", 1, 5), ("m", "method", 2, 4), ("n", "method", 3, 3), ("T", "type", 3, 5), ("U", "type", 6, 6), ("f", "function", 8, 9)}
    assert len(plans) == 1 and "Join" not in plans[0] and plans[0].count("Exchange") == 1
