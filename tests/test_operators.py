import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from revloom.functions import stats
from revloom.operators import brief, closure, codec, coordination, graph, history, linediff, objects, reviews, semdiff, similar, trees
from revloom.sources import files, git, sessions, symbols
from revloom.streaming import feeds, holds


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def code(spark, texts):
    return spark.createDataFrame([(i, "f", None, t) for i, t in enumerate(texts)], "seq long, file string, symbol string, text string")


def test_literal_anomaly(spark):
    got = semdiff.literal_anomalies(code(spark, ["x = y * 2"] * 15 + ["x = y * 3"])).collect()
    assert [(r.seq, r.reason) for r in got] == [(15, "literal 3 where 15/16 use 2")]


def test_operator_anomaly(spark):
    got = semdiff.operator_anomalies(code(spark, ["if (i <= n)"] * 9 + ["if (i < n)"])).collect()
    assert [(r.seq, r.reason) for r in got] == [(9, "operator < where 9/10 use <=")]


@pytest.mark.parametrize("texts", [[f"i = {k}" for k in range(20)], ["a(1)"] * 3 + ["a(2)"] * 2, ["a + b"] * 9 + ["a - b"]])
def test_no_anomaly(spark, texts):
    assert semdiff.all_anomalies(code(spark, texts)).isEmpty()


def test_groups(spark):
    got = semdiff.in_order(semdiff.shape_groups(code(spark, ["a = 1", "f(x)", "b = 2", "c = 3"]))).collect()
    assert [(r["shape"], r["n"], r["kind"]) for r in got] == [("_(_)", 1, "substantive"), ("_ = #", 3, "mechanical")]


def test_edits_rebuild_both_sides():
    random.seed(4)
    for _ in range(150):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 12))] for _ in range(2))
        ops = linediff.edits(a, b)
        assert [a[i] for t, i, _ in ops if t != "+"] == a and [b[j] for t, _, j in ops if t != "-"] == b


def test_hunks(spark):
    old, near, far = [f"l{k}" for k in range(40)], [f"l{k}" for k in range(40)], [f"l{k}" for k in range(40)]
    near[10] = near[14] = far[5] = far[26] = "x"
    pairs = spark.createDataFrame([("one", "a\nb\nc\nd\ne", "a\nb\nC\nd\ne"), ("near", "\n".join(old), "\n".join(near)), ("far", "\n".join(old), "\n".join(far)), ("same", "a", "a"), ("bin", "a\0", "b")], "key string, old string, new string")
    got = linediff.hunks(linediff.diff(pairs)).collect()
    assert [(r.old_start, r.old_len, r.new_start, r.new_len) for r in got if r.key == "one"] == [(1, 5, 1, 5)]
    assert {k: sum(r.key == k for r in got) for k in ("near", "far", "same", "bin")} == {"near": 1, "far": 2, "same": 0, "bin": 0}


def test_enclosing():
    lines = ["fn outer() {", "    if x {", "        y = 1", "    }", "}", "static T = [", "    3,", "]"]
    assert linediff.enclosing(lines, 2) == "fn outer" and linediff.enclosing(lines, 6) is None


def test_innermost(spark):
    lines = spark.createDataFrame([("f", k) for k in (1, 5, 70, 200)], "file string, line int")
    ranges = spark.createDataFrame([("f", "outer", 1, 100), ("f", "inner", 4, 6), ("f", "late", 65, 80)], "file string, name string, start_line int, end_line int")
    assert {r.line: r.symbol for r in linediff.innermost(lines, ranges).collect()} == {1: "outer", 5: "inner", 70: "late", 200: None}


def slow_ends(data):
    g, out, at = similar.gear(), [], 0
    while at < len(data):
        b, fp = data[at:], 0
        cut = end = min(len(b), similar.MOST)
        if len(b) > similar.LEAST:
            for i in range(similar.LEAST, end):
                fp = ((fp << 1) + int(g[b[i]])) & 0xFFFFFFFF
                if not fp & (similar.MASK_EARLY if i < similar.NORMAL else similar.MASK_LATE):
                    cut = i
                    break
        at += cut
        out.append(at)
    return out


@pytest.mark.parametrize("n", [0, 10, 2048, 3000, 150_000])
def test_chunks(n):
    data = random.Random(n).randbytes(n)
    assert similar.chunk_ends(data) == slow_ends(data)


def test_delta():
    rng = random.Random(1)
    base = rng.randbytes(5000)
    target = base[:1000] + b"xyz" * 20 + base[3000:] + base[500:900]
    ops = similar.delta(base, target)
    assert similar.expand(base, ops) == target and len(ops) < 200
    assert similar.expand(base, b"\x02") is None and similar.expand(b"ab", b"\x00\x01\x05") is None


def test_bases_stay_full(spark):
    pairs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "a")], "id string, base string")
    assert rows(similar.keep_bases_full(pairs, None)) == [("b", "a"), ("d", "c"), ("e", "a")]


def _slow_bases(sketches, full_only):
    out, full = [], []
    for rank, s in enumerate(sketches):
        best = max(((len(s & sketches[b]), -b) for b in (full if full_only else range(rank))), default=(0, 0))
        if best[0] >= similar.SHARED:
            out.append((str(rank), str(-best[1]), best[0]))
        else:
            full.append(rank)
    return sorted(out)


@pytest.mark.parametrize("full_only", [False, True])
def test_bases_exact(spark, full_only):
    """Against every pair compared: chains of near copies, equal sketches, sketches inside others, and 1,100 blobs with the same eight hashes."""
    rng = random.Random(5)
    sketches, own = [], iter(range(100, 10**6))
    for k in range(4):
        now = [next(own) for _ in range(24)]
        for _ in range(30):
            sketches.append(frozenset(now[: rng.choice((24, 24, 12, 7))]))
            now[rng.randrange(24)] = next(own)
            sketches += [sketches[-1]] * rng.choice((0, 0, 2))
    rng.shuffle(sketches)
    if not full_only:
        sketches += [frozenset([*range(7), *(next(own) for _ in range(17))]) for _ in range(1100)]
        sketches += [sketches[-1] - {0}]
    rows_of = spark.createDataFrame([(str(k), h) for k, s in enumerate(sketches) for h in s], "id string, h long")
    ranks = spark.createDataFrame([(str(k), k) for k in range(len(sketches))], "id string, rank long")
    got = (similar.best_full_bases if full_only else similar.best_bases)(rows_of, ranks)
    assert sorted(tuple(r) for r in got.collect()) == _slow_bases(sketches, full_only)


def test_codec():
    change = codec.Object(codec.CHANGE, {"parents": [b"a" * 32], "tree": b"t" * 32, "session": None, "intent": "é", "author": "y", "ts": 1 << 40, "verification": "red"})
    raw = codec.encode(change)
    assert codec.decode(raw) == change
    for bad, why in ((b"", "truncated"), (b"\x09", "bad-kind"), (raw + b"x", "trailing"), (raw[:-1], "truncated"), (raw[:-1] + b"\x07", "bad-tag")):
        with pytest.raises(codec.Malformed, match=why):
            codec.decode(bad)
    rng = random.Random(5)
    for _ in range(300):
        data = bytes([rng.randint(0, 6)]) + rng.randbytes(rng.randint(0, 50))
        try:
            assert codec.decode(codec.encode(codec.decode(data))) == codec.decode(data)
        except codec.Malformed:
            pass


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node for r in graph.dependencies(edges, start).collect()} == {"b", "c"}
    assert {r.node for r in graph.blast_radius(edges, start).collect()} == {"b", "c"}
    again = graph.reindexed(edges, spark.createDataFrame([("b",)], "src string"), spark.createDataFrame([], "src string, dst string"))
    assert rows(again) == [("a", "b"), ("c", "a")]
    with pytest.raises(ValueError):
        closure.levels(edges, edges.select(F.col("src").alias("node")))


def test_history(spark):
    c = spark.createDataFrame([(1, []), (2, [1]), (3, [2, 1]), (4, [3, 9])], "id long, parents array<long>")
    assert [r.id for r in history.log(c.where("id < 4"), spark.createDataFrame([(3,)], "head long")).orderBy("position").collect()] == [3, 2, 1]
    assert rows(history.boundary(c)) == [(4,)]
    assert {r.id: r.level for r in history.topological(c).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_trees(spark):
    f = spark.createDataFrame([("a/x", 33188, "1"), ("a/b/y", 33188, "2"), ("z", 33261, "3")], "path string, mode int, id string")
    ids = {r.dir: r.tree_id for r in trees.tree_ids(f).collect()}
    assert set(ids) == {"", "a", "a/b"}
    entries = trees.tree_ids(f).select("tree_id", F.explode("entries").alias("e")).select("tree_id", F.col("e.name").alias("name"), F.col("e.mode").alias("mode"), F.col("e.id").alias("child_id"))
    flat = trees.flatten(entries, spark.createDataFrame([(ids[""],)], "root string"))
    assert rows(flat.select("path", "mode", "id")) == rows(f)
    g = spark.createDataFrame([("a/x", 33261, "1"), ("z/q", 33188, "9"), ("a/b/y", 33188, "2")], "path string, mode int, id string")
    assert rows(trees.diff(f, g).select("path", "kind")) == [("a/x", "M"), ("z", "D"), ("z/q", "A")]
    assert rows(trees.diff(f, g, with_mode=False).select("path", "kind")) == [("z", "D"), ("z/q", "A")]


def test_seal(spark):
    ring = spark.createDataFrame([("k1", b"0" * 32), ("k2", b"1" * 32)], "key_id string, key binary")
    sealed = objects.seal(spark.createDataFrame([(b"one", "k1"), (b"two", "k2")], "payload binary, key_id string"), ring)
    left, gone = objects.erase(sealed, ring, "k2")
    assert {r.key_id: (r.status, r.payload and bytes(r.payload)) for r in objects.unseal(sealed, left).collect()} == {"k1": ("plaintext", b"one"), "k2": ("shredded", None)}
    assert gone.collect()[0][0] == 1
    wrong = left.withColumn("key", F.lit(b"9" * 32))
    assert objects.unseal(sealed, wrong).where("key_id = 'k1'").collect()[0].status == "corrupt"


def test_predict(spark):
    h = spark.createDataFrame([("d/a", "x", "t", 0), ("d/b", "x", "t", 0), ("root", "x", "t", 0), ("d/own", "me", "t", 0), ("q/s", "x", "t", 0)], "file string, agent string, task string, taken long")
    wanted = spark.createDataFrame([("me", "d/w"), ("me", "top")], "agent string, file string")
    edges = spark.createDataFrame([("d/w", "d/a")], "src string, dst string")
    shared = spark.createDataFrame([("d/w", "d/a"), ("d/w", "q/s")], "file string, other string")
    got = coordination.predict(h, wanted, edges, shared)
    assert rows(got.select("held_file", "relation")) == [("d/a", "imports"), ("d/b", "same-dir"), ("q/s", "shared-symbol")]


def test_restore(spark):
    h = spark.createDataFrame([("a", "x", "t", 940), ("b", "x", "t", -2600), ("c", "x", "t", 9999)], "file string, agent string, task string, taken long")
    assert rows(coordination.restored(h, 1000).select("file", "taken")) == [("a", 940), ("c", 1000)]


def test_budget(spark):
    d = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([400, 40, 4000, 4])], "qid int, position int, text string")
    assert [r.position for r in brief.within_budget(d, 110).collect()] == [0, 1] and [r.position for r in brief.within_budget(d, 1).collect()] == [0]


def test_statistics(spark):
    r = spark.range(1).select(stats.erf(F.lit(0.5)).alias("a"), stats.erf(F.lit(-4.0)).alias("b"), F.struct(*stats.wilson(F.lit(0), F.lit(0))).alias("w")).collect()[0]
    assert abs(r.a - 0.5204998778130465) < 1e-12 and abs(r.b + 0.9999999845827421) < 1e-12 and tuple(r.w) == (0.0, 0.0)
    p = spark.createDataFrame([("f", k, v) for k, v in enumerate([0.01, 0.02, 0.03, 0.2])], "f string, k int, p double")
    assert [x.rejected for x in stats.holm(p, ["f"]).orderBy("rank").collect()] == [True, False, False, False]


def test_reviews(spark):
    r = spark.createDataFrame([("1", "t", "a", True, "approve", "Good", ["x"], []), ("2", "t", "b", False, "reject", "bad", [], []), ("3", "u", "a", True, "approve", "ok", ["x"], [])], "id string, target string, reviewer string, by_human boolean, verdict string, summary string, labels array<string>, findings array<string>")
    assert [x.id for x in reviews.find(r, disputed=True, label="x").collect()] == ["1"]
    proof = {x.path: x.proof for x in reviews.proof(spark.createDataFrame([("core.rs", "M"), ("core_test.rs", "M"), ("other.rs", "M")], "path string, kind string")).collect()}
    assert proof == {"core.rs": "covered", "core_test.rs": "test", "other.rs": "untested"}


def test_git(spark, tmp_path):
    blob, tree = b"hello\n", git.tree_payload([(0o100644, "a.txt", git.oid_of("blob", b"hello\n"))])
    assert git.oid_of("blob", blob) == "ce013625030ba8dba906f756967f9e9ca394464a"
    commit = b"tree " + git.oid_of("tree", tree).encode() + b"\nauthor A B <a@b.example> 1700000000 +0000\ncommitter X <x> 1 +0000\n\nmessage\n"
    objs = {git.oid_of(k, p): (k, p) for k, p in (("blob", blob), ("tree", tree), ("commit", commit))}
    top = tmp_path / "objects"
    for oid, (k, p) in objs.items():
        (top / oid[:2]).mkdir(parents=True, exist_ok=True)
        (top / oid[:2] / oid[2:]).write_bytes(zlib.compress(f"{k} {len(p)}".encode() + b"\0" + p))
    base, target = b"a" * 300 + b"tail", b"a" * 300 + b"TAIL"
    ops = bytes([0xB0, 0x02, 0xB0, 0x02, 0xB0, 300 & 255, 1, 4]) + b"TAIL"  # sizes 304 and 304; copy 300 bytes from 0; 4 literals
    pack = b"PACK" + (2).to_bytes(4, "big") + (2).to_bytes(4, "big")
    head = lambda kind, n: bytes([kind << 4 | n & 15 | 128, n >> 4]) if n > 15 else bytes([kind << 4 | n])
    first = head(3, len(base)) + zlib.compress(base)
    pack += first + head(6, len(ops)) + bytes([len(first)]) + zlib.compress(ops)
    (top / "pack").mkdir()
    (top / "pack" / "p.pack").write_bytes(pack + b"\0" * 20)
    got = git.objects(spark, f"file://{tmp_path}")
    assert {r.oid: (r.kind, bytes(r.payload)) for r in got.collect()} == objs | {git.oid_of("blob", base): ("blob", base), git.oid_of("blob", target): ("blob", target)}
    c = git.commits(got).collect()[0]
    assert (c.author, c.ts, c.parents) == ("A B <a@b.example>", 1700000000, [])
    assert rows(git.bridged(got).select("path", "id")) == [("a.txt", git.oid_of("blob", blob))]


def test_ignore():
    ig = files.Ignore({"": ["*.log", "build/", "!keep.log", "/top"], "sub": ["!x.log", "*.tmp"]})
    want = {"a.log": True, "keep.log": False, "sub/x.log": False, "sub/y.log": True, "build/o": True, "top": True, "sub/top": False, "sub/a.tmp": True, "a.tmp": False, ".git/config": True}
    assert {p: ig(p) for p in want} == want


def test_walk_and_checkout(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "d").mkdir(parents=True)
    (src / "d" / "a.txt").write_text("one")
    (src / "b.bin").write_bytes(b"x\0y")
    listing = files.as_blobs(files.walk(spark, f"file://{src}"))
    assert {r.path: r.is_binary for r in listing.collect()} == {"d/a.txt": False, "b.bin": True}
    done = files.checkout(listing.select("path", F.lit(0o100644).alias("mode"), "content").unionByName(spark.createDataFrame([("../evil", 0o100644, b"x")], "path string, mode int, content binary")), str(out))
    assert {r.path: r.status for r in done.collect()} == {"d/a.txt": "written", "b.bin": "written", "../evil": "unsafe"}
    assert (out / "d" / "a.txt").read_text() == "one" and not os.path.exists(tmp_path / "evil")


def test_sessions(spark):
    said = ['{"type":"user","message":{"content":"fix the\\nbug"}}', "junk", '{"type":"assistant","message":{"model":"m1","usage":{"input_tokens":5,"output_tokens":7},"content":[{"type":"text","text":"ok"},{"type":"tool_use","name":"grep"}]}}', '{"type":"assistant","message":{"model":"m2","usage":{"input_tokens":1,"output_tokens":2},"content":[{"type":"tool_use","name":"edit"},{"type":"tool_use","name":"grep"}]}}']
    r = sessions.from_lines(spark.createDataFrame([("s", i, v) for i, v in enumerate(said)], "session string, seq int, value string")).collect()[0]
    assert (r.task, r.model, r.tokens_in, r.tokens_out, r.tool_calls) == ("fix the", "m2", 6, 9, ["grep", "edit"])
    s, p = sessions.from_json(spark.createDataFrame([("i", '{"task":"t","prompts":"hi","tool_calls":["a","b"],"verification":"green"}', "m")], "id string, value string, message string"))
    assert p.count() == 3 and s.collect()[0].verification == "green"


def test_go_imports_and_c_names(spark):
    src = '// import "a"\npackage m /* import "b" */\nimport "fmt"; import f `raw/p`\nimport (\n "a/b" // c\n . "dot/x"\n _ "blank/y"\n /* "n" */ z "q")\nvar x = "import \\"q\\""\nimport "late"\n'
    assert list(symbols._go_specs(src)) == ["fmt", "raw/p", "a/b", "dot/x", "blank/y", "q"]
    assert not list(symbols._go_specs("")) and list(symbols._go_specs('import ("a" /* open')) == ["a"]
    c = spark.createDataFrame([("  static int begin(int a) { if (a) { return f(a); } while (a) { } }\nint g(void);\nvoid h(x,\n y)\n{ }", "t")], "text string, k string")
    assert sorted(c.select(symbols.c_functions(F.col("text"))).collect()[0][0]) == ["begin", "h"]


def test_imports_and_symbols(spark):
    fs = spark.createDataFrame([
        ("src/a.ts", "import {x} from './b';\nimport y from \"../lib/c.js\";"), ("src/b.ts", ""), ("lib/c.ts", ""), ("p/m.py", "from . import q\nfrom .q import z\nimport p.q\n@dec\ndef f():\n    return g(1)\n\nclass C:\n    def h(self): pass\n"), ("p/q.py", ""), ("p/__init__.py", ""),
        ("m.go", 'package m\nimport (\n "ex.org/r/sub"\n)\nfunc (t *T) Run(a int) int {\n  return go1(a)\n}\n'), ("sub/s.go", ""), ("sub/s_test.go", ""), ("c/x.c", '#include "x.h"\n#include <y.h>'), ("c/x.h", ""), ("include/y.h", ""),
    ], "path string, text string")
    got = set(rows(symbols.imports(fs, "ex.org/r")))
    assert {("src/a.ts", "src/b.ts"), ("src/a.ts", "lib/c.ts"), ("p/m.py", "p/q.py"), ("p/m.py", "p/__init__.py"), ("m.go", "sub/s.go"), ("c/x.c", "c/x.h"), ("c/x.c", "include/y.h")} == got
    s = {(r.name, r.kind, r.start_line, r.end_line) for r in symbols.symbols(fs).collect()}
    assert {("f", "function", 4, 6), ("C", "class", 8, 9), ("h", "method", 9, 9), ("Run", "method", 5, 7)} <= s
    assert ("p/m.py", "f", "g") in rows(symbols.calls(fs))


def test_hold_stream(spark, tmp_path):
    schema = "repo string, agent string, file string, task string, kind string, ts long, seq long"
    spark.createDataFrame([("r", "a", "f", "t", "reserve", 0, 0), ("r", "b", "f", "t", "reserve", 10, 1), ("r", "a", None, None, "release", 20, 2), ("q", "b", "f", "t", "reserve", 30, 3)], schema).write.parquet(str(tmp_path / "in"))
    out = feeds.table_run(holds.reservations(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
    assert rows(out.select("repo", "ts", "granted")) == [("q", 30, True), ("r", 0, True), ("r", 10, False), ("r", 20, True)]


def test_edge_feed(spark, tmp_path):
    schema = "seq long, src string, deleted boolean, dsts array<string>"
    store = feeds.Versions(spark, f"file://{tmp_path}/edges", "src string, dst string")
    store.write(spark.createDataFrame([("a", "x"), ("b", "x")], "src string, dst string"), -1)
    spark.createDataFrame([(1, "a", False, ["y"]), (2, "b", True, []), (3, "c", False, ["a", "a"])], schema).write.parquet(str(tmp_path / "in"))
    feeds.maintain_edges(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    assert rows(store.read()) == [("a", "y"), ("c", "a")]


def test_run_verdicts(spark):
    """Two runs: other manifests, nothing shared, a real change, equal within the margin, too few trials; impossible counts don't count."""
    from revloom.functions import stats

    def said(a, b, manifests=("m", "m")):
        rows = lambda got: spark.createDataFrame([(k, "with", x, n) for k, (x, n) in got.items()], "bench string, condition string, correct int, total int")
        return tuple(stats.verdict(stats.compare_runs(rows(a), rows(b)), manifests).collect()[0])

    many = {"x": (450, 500), "y": (100, 500)}
    assert said(many, many) == ("equivalent", 0)
    assert said(many, many, ("m", "other")) == said(many, many, (None, None)) == ("manifest_mismatch", 2)
    assert said(many, {"x": (300, 500), "y": (100, 500)}) == ("regression", 1)
    assert said({"x": (5, 10)}, {"x": (5, 10)}) == ("inconclusive", 2)
    assert said({"x": (5, 10)}, {"y": (5, 10)}) == said({"x": (5, 4)}, {"x": (5, 10)}) == ("no_data", 2)
    r = stats.compare_runs(*(spark.createDataFrame([("x", "with", k, 100)], "bench string, condition string, correct int, total int") for k in (80, 70))).collect()[0]
    assert abs(r.diff - 0.1) < 1e-12 and abs((r.high - r.low) / 2 - 1.96 * (0.8 * 0.2 / 100 + 0.7 * 0.3 / 100) ** 0.5) < 1e-12 and abs(r.p - 0.1025) < 1e-3


def test_saved_graph(spark):
    """Lines without a file are skipped, numbers that are none are 0, a file's last line counts, a table without lines gives none."""
    from revloom.operators import graph

    lines = [("a\t5\t7\tb\tc", 0), ("\t1\t2\td", 1), ("b\tx", 2), ("c", 3), ("", 4), (None, 5), ("a\t6\t8\td", 6)]
    got = graph.loaded(spark.createDataFrame(lines, "value string, seq int"))
    assert rows(got) == [("a", 6, 8, ["d"]), ("b", 0, 0, []), ("c", 0, 0, [])]
    assert rows(graph.loaded(graph.saved(got).selectExpr("value", "0 AS seq"))) == rows(got)
    assert rows(graph.loaded(spark.createDataFrame([], "value string, seq int"))) == []


def test_pins_reviews_contents(spark):
    from revloom.operators import reviews, store

    log = spark.createDataFrame([("f", "old", 1), ("f", "new", 2), ("g", "gone", 1), ("g", None, 2), ("a", "x", 1)], "symbol string, lesson string, seq int")
    assert [tuple(r) for r in store.pins(log).collect()] == [("a", "x"), ("f", "new")]
    new = spark.createDataFrame([("t", "r", True, "reject", "s", ["l"], [])] * 2 + [("t", "r", True, "odd", "s", ["l"], []), (None, "r", True, "reject", "s", ["l"], [])], "target string, reviewer string, by_human boolean, verdict string, summary string, labels array<string>, findings array<string>")
    once = reviews.record(spark.createDataFrame([], "id string"), new)
    assert once.count() == 1 and reviews.record(once, new).count() == 0
    listing = spark.createDataFrame([("c", "a/b", "1"), ("c", "d", "2")], "change string, path string, id string")
    wanted = spark.createDataFrame([("c", "a/b"), ("c", "a/b"), ("c", "a"), ("c", "d"), ("x", "d")], "change string, path string")
    assert rows(store.bytes_at(listing, wanted, spark.createDataFrame([("1", "one")], "id string, content string"))) == [("c", "a/b", "1", "one")]
