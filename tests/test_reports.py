from pyspark.sql import functions as F

from revloom.operators import reports, store


def test_reports(spark):
    old = "fn f() {\n" + "".join(f"    set({k}, 2);\n" for k in range(6)) + "}\n"
    new = "fn f() {\n" + "".join(f"    set({k}, 4);\n" if k else "    set(0, 9);\n" for k in range(6)) + "}\n"
    files = spark.createDataFrame([("c", "src/a.rs", "M", old, new), ("c", "src/a_test.rs", "A", None, "x\n"), ("d", "bin", "M", "a\0", "b\0")], "change string, path string, kind string, old string, new string")
    w = {(r.change, r.path): (r.added, r.deleted, r.proof) for r in reports.walkthrough(files).collect()}
    assert w == {("c", "src/a.rs"): (6, 6, "covered"), ("c", "src/a_test.rs"): (1, 0, "test"), ("d", "bin"): (0, 0, "untested")}
    lines = reports.semantic_lines(files)
    assert {(r.side, r.symbol) for r in lines.where("file = 'src/a.rs'").collect()} == {("added", "fn f"), ("removed", "fn f")}
    _, odd = reports.semantic(files)
    assert [(r.side, r.text.strip(), r.reason) for r in odd.collect()] == [("added", "set(0, 9);", "literal 9 where 5/6 use 4")]
    assert reports.unified(files).where("path = 'src/a.rs'").collect()[0].old_len == 8


def test_store(spark):
    log = spark.createDataFrame([("main", "a", 1), ("old", "b", 2), ("old", None, 3)], "name string, id string, seq long")
    assert [tuple(r) for r in store.refs(log).collect()] == [("main", "a")]
    assert store.swap(log, "main", "x", "y") is None and store.swap(log, "main", "a", "y").collect()[0].seq == 4
    changes = spark.createDataFrame([], "id string")
    new, moved = store.commit(changes, log, "main", {"tree_id": "t", "intent": "i", "author": "me", "ts": 5})
    assert new.collect()[0].parents == ["a"] and moved.collect()[0].id == new.collect()[0].id
    kv = spark.createDataFrame([("n", "k", "1", 1), ("n", "k", "2", 2), ("n", "gone", "1", 1), ("n", "gone", None, 2), ("m", "k", "9", 9)], "ns string, key string, value string, seq long")
    assert [tuple(r) for r in store.namespace(kv, "n").collect()] == [("k", "2")]
    assert [r.key for r in store.get_or_insert(kv, "n", spark.createDataFrame([("k", "x"), ("z", "y")], "key string, value string")).collect()] == ["z"]
    ops = spark.createDataFrame([(1, "a", "b"), (2, "b", "c")], "seq int, before string, after string")
    assert store.undo(ops, "c").count() == 1 and store.undo(ops, "b").count() == 0
    served = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "seq int, lesson string")
    assert {r.lesson for r in store.learned(served, "c", "t", "l", 1)[1].select(F.col("lesson")).collect()} == {"y", "z"}


def test_diffs_pass_without_a_shuffle_of_texts(spark):
    """texts stay where they are read, and equal pairs, repeated rows and slices of a batch lose nothing."""
    rows = [(f"c{k}", f"p{k % 700}", "M", "fn f() {\n    a;\n}\n", f"fn f() {{\n    b{k % 3};\n}}\n") for k in range(1000)] + [("c0", "p0", "M", "fn f() {\n    a;\n}\n", "fn f() {\n    b0;\n}\n"), ("n", "gone", "D", "x\n", None)]
    files = spark.createDataFrame(rows, "change string, path string, kind string, old string, new string").coalesce(1)
    lines = reports.semantic_lines(files)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    got = lines.groupBy("side", "symbol", "text").count().collect()
    assert {(r.side, r.symbol, r.text): r["count"] for r in got} == {("removed", "fn f", "    a;"): 1001, **{("added", "fn f", f"    b{k};"): 334 + (k == 0) - (k > 0) for k in range(3)}, ("removed", None, "x"): 1}
    assert "Exchange" not in reports.unified(files)._jdf.queryExecution().executedPlan().toString() and reports.unified(files).count() == 1002
    assert reports.walkthrough(files).agg(F.sum("added"), F.sum("deleted")).collect()[0][:] == (1001, 1002)
