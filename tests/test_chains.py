"""Chains of deltas and pointers against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revloom.operators import chains, closure, objects, similar


def ident(body):
    import hashlib

    return hashlib.sha256(b"\1" + body).hexdigest()


def stored(spark, full, deltas):
    return (
        spark.createDataFrame([(ident(b) if i is None else i, bytearray(b)) for i, b in full], "id string, body binary"),
        spark.createDataFrame([(i, u, None if o is None else bytearray(o)) for i, u, o in deltas], "id string, base string, ops binary"),
    )


def edited(rng, text):
    at = rng.randrange(len(text) + 1)
    return text[:at] + bytes(rng.choices(b"abcdef \n", k=rng.randint(0, 30))) + text[at + rng.randint(0, 40) :]


@pytest.mark.parametrize("seed", range(6))
def test_composed(seed):
    """Any two deltas in a row are one, with the same target."""
    rng = random.Random(seed)
    a = bytes(rng.choices(b"abcdefghij \n", k=400))
    now, delta = a, None
    for _ in range(12):
        new = edited(rng, now)
        step = chains.parsed(similar.delta(now, new))
        assert chains.applied(now, *step) == new
        delta = step if delta is None else chains.composed(step, delta)
        now = new
        assert chains.applied(a, *delta) == now


def test_composed_beyond():
    outer, inner = chains.parsed(b"\0\5\6"), chains.parsed(b"\1\3abc")
    assert chains.composed(outer, inner) is None and chains.applied(b"0123456789", *outer) is None and chains.applied(b"0123456789a", *outer) == b"56789a"
    assert chains.parsed(b"\1\5ab") is None and chains.parsed(b"\2\1\1") is None and chains.parsed(b"\0\1") is None
    assert [x.tolist() if isinstance(x, np.ndarray) else x for x in chains.parsed(b"")] == [[], b""]
    assert chains.applied(b"xyz", *chains.parsed(b"")) == b""


def test_deep_chain(spark):
    """4,096 deltas deep is read; one more isn't."""
    body = lambda k: b"line of the file, version %d;" % (k // 3) + b"x" * (k % 5)
    texts, seen = [], set()
    for k in range(6300):
        if body(k) not in seen:
            seen.add(body(k))
            texts.append(body(k))
    texts = texts[:4098]
    assert len(texts) == 4098
    full, deltas = stored(spark, [(None, texts[0])], [(ident(b), ident(a), similar.delta(a, b)) for a, b in zip(texts, texts[1:], strict=False)])
    got = {r.id: r for r in chains.restored(full, deltas).collect()}
    assert len(got) == 4098
    assert all(got[ident(t)].status == "ok" and bytes(got[ident(t)].body) == t and got[ident(t)].depth == k for k, t in enumerate(texts[:4097]))
    assert got[ident(texts[4097])].status == "deep" and got[ident(texts[4097])].body is None


def test_faults(spark):
    a, b, c = b"a long enough first text", b"a long enough second text", b"a long enough third text"
    good = [(ident(b), ident(a), similar.delta(a, b)), (ident(c), ident(b), similar.delta(b, c))]
    bad = [
        ("gone1", "nowhere", b"\0\0\1"), ("gone2", "gone1", b"\0\0\1"), ("self", "self", b"\0\0\1"), ("x", "y", b"\0\0\1"), ("y", "z", b"\0\0\1"), ("z", "x", b"\0\0\1"), ("tail", "x", b"\0\0\1"),
        ("unread", ident(a), b"\7"), ("none", ident(a), None), ("on", "unread", b"\0\0\1"), ("beyond", ident(a), b"\0\0\x7f"), ("beyond2", "beyond", b"\0\0\x7f"), ("too", ident(b), b"\0\x14\x7f"), ("other", ident(c), b"\0\0\4"),
    ]
    full, deltas = stored(spark, [(None, a), ("wrong", b"not its bytes")], good + bad)
    got = {r.id: (r.status, r.body and bytes(r.body)) for r in chains.restored(full, deltas).collect()}
    assert got == {
        ident(a): ("ok", a), ident(b): ("ok", b), ident(c): ("ok", c), "wrong": ("corrupt", None), "gone1": ("missing", None), "gone2": ("missing", None), "self": ("cycle", None), "x": ("cycle", None), "y": ("cycle", None), "z": ("cycle", None),
        "tail": ("cycle", None), "unread": ("malformed", None), "none": ("malformed", None), "on": ("malformed", None), "beyond": ("malformed", None), "beyond2": ("malformed", None), "too": ("malformed", None), "other": ("corrupt", None),
    }


def test_none(spark):
    assert chains.restored(*stored(spark, [], [])).count() == 0
    assert [r.status for r in chains.restored(*stored(spark, [(None, b"")], [])).collect()] == ["ok"]


def test_many_on_one(spark):
    """A third of all deltas on one base."""
    base = b"the common base of very many texts, " * 3
    each = [base + b"%d" % k for k in range(3000)]
    full, deltas = stored(spark, [(None, base)], [(ident(t), ident(base), similar.delta(base, t)) for t in each])
    assert chains.restored(full, deltas).where("status = 'ok'").count() == 3001


@pytest.mark.parametrize("seed", range(3))
def test_ends_and_along(spark, seed):
    rng = random.Random(seed)
    up = {k: rng.choice([k - 1, k - 2, rng.randrange(60)]) for k in range(1, 60) if rng.random() > 0.1}

    def way(k):
        out = [k]
        while k in up:
            k = up[k]
            if k in out:
                return None
            out.append(k)
        return out

    pointers = spark.createDataFrame([(k, v) for k, v in up.items()], "id long, up long")
    want = {k: (None, None) if way(k) is None else (way(k)[-1], len(way(k)) - 1) for k in up}
    assert {r.id: (r.last, r.depth) for r in closure.ends(pointers).collect()} == want
    fine = {k: v for k, v in up.items() if way(k)}
    starts = spark.createDataFrame([(k, k) for k in range(60)], "root long, node long")
    got = closure.along(starts, pointers.where(F.col("id").isin(list(fine)))).collect()
    assert sorted((r.root, r.node, r.depth) for r in got) == sorted((k, n, d) for k in range(60) for d, n in enumerate(way(k) if k in fine else [k]))


def test_ids(spark):
    assert spark.range(1).select(objects.object_id("blob", F.lit(b"text"))).first()[0] == ident(b"text")


def test_reach_by_hops_of_growing_length(spark):
    """a deep graph with cycles, with and without a bound on the depth: least depths, in far fewer rounds than steps."""
    n, cuts = 300, []
    links = {(k, k // 2) for k in range(1, n)} | {(k, k - 1) for k in range(1, n) if k % 3} | {(k, (k * 7 + 1) % n) for k in range(0, n, 25)}
    near = {}
    for root in range(0, n, 7):
        at, front = {root: 0}, [root]
        while front:
            front = [d for s in front for a, d in links if a == s and d not in at and not at.update({d: at[s] + 1})]
        near |= {(root, node): d for node, d in at.items()}
    edges = spark.createDataFrame(sorted(links), "src long, dst long")
    starts = spark.createDataFrame([(k, k) for k in range(0, n, 7)], "root long, node long")
    chain = spark.createDataFrame([(k, k + 1) for k in range(64)], "src long, dst long")
    for depth in (None, 1, 3, 6):
        got = {(r.root, r.node): r.depth for r in closure.reach(starts, edges, depth, keep_starts=True).collect()}
        assert got == {k: d for k, d in near.items() if depth is None or d <= depth}
    cut, closure._cut = closure._cut, lambda df: cuts.append(1) or cut(df)
    try:
        assert closure.reach(chain.selectExpr("src as root", "src as node"), chain).count() == 64 * 65 // 2
    finally:
        closure._cut = cut
    assert len(cuts) < 20
