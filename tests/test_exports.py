"""Resolution of exported names against a plain resolver."""

import random

import pytest

from revloom.operators import exports

D, I, E = "file string, name string", "file string, local string, source string, name string", "file string, name string, local string, source string"


def plain(declares, imports, exported, file, name):
    """The declarations that can be reached."""
    seen, todo, out = set(), [(file, name)], set()
    own, taken = set(declares), {(f, local): (s, n) for f, local, s, n in imports}
    explicit = {(f, n): (local, s) for f, n, local, s in exported if n != "*"}
    while todo:
        f, n = todo.pop()
        if (f, n) in seen:
            continue
        seen.add((f, n))
        if (f, n) in explicit:
            local, source = explicit[f, n]
            if source is None and (f, local) in own:
                out.add((f, local))
                continue
            to = taken.get((f, local)) if source is None else (source, local)
            if to and to[1] == "*":
                out.add(to)
            elif to:
                todo.append(to)
        elif n != "default":
            todo += [(s, n) for g, m, _, s in exported if g == f and m == "*"]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_resolve(spark, seed):
    rng = random.Random(seed)
    files, names = [f"f{k}" for k in range(12)], ["a", "b", "c", "d", "default"]
    declares = sorted({(rng.choice(files), rng.choice(names)) for _ in range(10)})
    imports = list({(f, x): (f, x, rng.choice(files), rng.choice([*names, "*"])) for f in files for x in rng.sample(names, 2) if rng.random() < 0.4}.values())
    exported = list({(f, n): (f, n, rng.choice([*names, "*"]), s) if s else (f, n, rng.choice(names), None) for f in files for n in rng.sample(names, 3) for s in [rng.choice([None, *files])]}.values())
    exported += [(f, "*", "*", s) for f in files for s in rng.sample(files, rng.choice([0, 1, 1, 2]))]
    asked = [(f, n) for f in files for n in [*names, "nowhere"]]
    got = exports.resolve(spark.createDataFrame(declares, D), spark.createDataFrame(imports, I), spark.createDataFrame(exported, E), spark.createDataFrame(asked + asked[:3], D)).collect()
    assert len(got) == len(asked)
    for r in got:
        want = plain(declares, imports, exported, r.file, r.name)
        assert (r.status, r.at_file, r.at_name) == (("one", *next(iter(want))) if len(want) == 1 else ("ambiguous" if want else "none", None, None)), (r, want)


def test_callees(spark):
    declares = [("lib/a", "f"), ("lib/a", "g"), ("lib/b", "g"), ("main", "own"), ("lib/d", "dflt")]
    imports = [("main", "run", "index", "go"), ("main", "ns", "lib/b", "*"), ("main", "box", "index", "space"), ("main", "own", "lib/a", "f"), ("main", "both", "index", "g"), ("main", "d", "lib/d", "default"), ("main", "lost", "outside", "x"), ("mid", "f", "lib/a", "f")]
    exported = [
        ("lib/a", "f", "f", None), ("lib/a", "g", "g", None), ("lib/b", "g", "g", None), ("index", "*", "*", "lib/a"), ("index", "*", "*", "lib/b"), ("index", "go", "passed", "mid"), ("mid", "passed", "f", None), ("index", "space", "*", "lib/a"),
        ("lib/d", "default", "dflt", None),
    ]
    calls = [("main", "own", c) for c in ("run", "ns.g", "ns.none", "box.g", "own", "both", "d", "lost", "print", "ns", "own.x")] + [("main", "own", "run")]
    got = exports.callees(spark.createDataFrame(calls, "file string, caller string, callee string"), spark.createDataFrame(declares, D), spark.createDataFrame(imports, I), spark.createDataFrame(exported, E)).collect()
    assert sorted((r.callee, r.at_file, r.at_name) for r in got) == [("box.g", "lib/a", "g"), ("d", "lib/d", "dflt"), ("ns.g", "lib/b", "g"), ("own", "main", "own"), ("run", "lib/a", "f")]


def test_nothing(spark):
    none = spark.createDataFrame([], D), spark.createDataFrame([], I), spark.createDataFrame([], E)
    assert [tuple(r) for r in exports.resolve(*none, spark.createDataFrame([("a", "b")], D)).collect()] == [("a", "b", "none", None, None)]
    assert exports.callees(spark.createDataFrame([], "file string, caller string, callee string"), *none).count() == 0


def test_tables_stay_off_the_driver(spark, tmp_path):
    """A table that a few numbers in a file grow into is small only in Spark's estimate (F7: 193 MB were broadcast)."""
    spark.range(2000).write.parquet(str(tmp_path / "parts"))
    k = spark.read.parquet(str(tmp_path / "parts")).selectExpr("cast(id as string) AS file", "id")
    declares = k.selectExpr("file", "concat('f', id) AS name")
    imports = k.selectExpr("file", "'h' AS local", "file AS source", "concat('g', id) AS name")
    exported = k.selectExpr("file", "concat('g', id) AS name", "concat('f', id) AS local", "cast(null as string) AS source")
    for df in (exports.targets(declares, imports, exported), exports.resolve(declares, imports, exported, exported.select("file", "name"))):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    assert exports.resolve(declares, imports, exported, exported.select("file", "name")).where("status = 'one' and at_file = file").count() == 2000


def test_ends_takes_rounds_for_ways_that_end(spark, monkeypatch):
    from revloom.operators import closure

    cut, calls = closure._cut, []
    monkeypatch.setattr(closure, "_cut", lambda df: calls.append(1) or cut(df))
    ring = [(k, (k + 1) % 500) for k in range(500)]
    way = [(k, k + 1) for k in range(1000, 1007)] + [(2000, 3), (2001, 2000)]
    got = {r["id"]: (r["last"], r["depth"]) for r in closure.ends(spark.createDataFrame(ring + way, "id long, up long")).collect()}
    assert got == {k: (None, None) for k, _ in ring} | {2000: (None, None), 2001: (None, None)} | {k: (1007, 1007 - k) for k in range(1000, 1007)}
    assert len(calls) <= 6
    only = closure.ends(spark.createDataFrame(ring, "id long, up long")).collect()
    assert len(only) == 500 and all(r["last"] is None and r["depth"] is None for r in only)
